import random
import re

import xxhash

from leafwork.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = WORD.findall((text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    """Smallest id within reach over all pairs at 3 bits or fewer."""
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def unsigned(fp):
    return fp & (1 << 64) - 1


def test_every_near_pair_shares_a_mask():
    for _ in range(2000):
        changed = sum(1 << p for p in random.sample(range(64), random.randint(0, 3)))
        assert any(not changed & m for m in simhash.MASKS)
        for v, m in enumerate(simhash.MASKS):
            if not changed & m:
                assert any(not changed & (m | inner) for inner in simhash.INNER[v])
    for v, m in enumerate(simhash.MASKS):
        assert all((m | inner).bit_count() >= 48 for inner in simhash.INNER[v])


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "BETA", "gämma", "delta,", "Ñu", "x" * 40]
    texts = [None, "", " \t\n", "one", "One  TWO", "a\x0bb c", "é\xa0é x y z", "x y z " * 3000]
    for _ in range(60):
        base = [rng.choice(words) + str(rng.randint(0, 30)) for _ in range(rng.randint(3, 60))]
        for _ in range(3):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "other"
            texts.append(rng.choice([" ", "\n"]).join(copy))
    rows = [(i * 3 % 997, t, None, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    want = {i: fingerprint(t) for i, t, *_ in rows}
    assert {i: unsigned(r.fp) for i, r in got.items()} == want
    assert {i: r.component_id for i, r in got.items()} == groups(want)


def test_hot_buckets_are_dealt_again(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    links = {(unsigned(r.a), unsigned(r.b)) for r in simhash.links(df, hot=8).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    label = {x: x for x in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[find(a)] = find(b)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                assert find(a) == find(b)


def test_null_ids_repeats_and_empty_tables(spark):
    kind = "doc_id long, text string"
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q"), (None, "q")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (None, None)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    kept = simhash.one_of_each(spark.createDataFrame(rows, kind)).collect()
    assert sum(r.doc_id == 7 for r in kept) == 1
    assert sum(r.doc_id is None for r in kept) == 3


def test_a_repeated_id_stands_for_each_of_its_groups(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b), (7, c), (7, None), (None, c)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(3, a), (5, b), (7, c), (7, None), (None, c)], key=str)
    kept = simhash.one_of_each(spark.createDataFrame([(5, a), (5, b)], "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted([a, b])


def test_one_of_each_of_odd_tables(spark):
    kind = "doc_id long, text string, __row string, meta map<string,string>"
    assert simhash.one_of_each(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "same text here", "a", {"k": "v"}), (1, "same text here", "b", None), (2, "same text here", "c", None), (None, "same text here", "d", None), (None, None, "e", None), (None, None, "f", None)]
    got = simhash.one_of_each(spark.createDataFrame(rows, kind))
    assert got.columns == ["doc_id", "text", "__row", "meta"]
    found = [(r.doc_id, r["__row"]) for r in got.collect()]
    assert sorted(x for i, x in found if i is None) == ["d", "e", "f"]
    assert [i for i, _ in found if i is not None] == [1]
