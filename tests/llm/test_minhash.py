import base64
import hashlib
import random

import numpy as np
import pyarrow as pa

from leafwork.llm import minhash, textnum


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_estimates_jaccard():
    rng = random.Random(1)
    errors = []
    for _ in range(60):
        a = [str(rng.randint(0, 500)) for _ in range(300)]
        b = list(a)
        for _ in range(rng.randint(0, 40)):
            b[rng.randrange(300)] = "x"
        a, b = " ".join(a), "  ".join(b)
        s = minhash.signatures(pa.array([a, b]))
        errors.append(minhash.likeness(s[:1], s[1:])[0] - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.03
    assert np.abs(errors).max() < 0.2


def test_successors_and_edited_texts(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10_000), 300)
    texts = {i: " ".join(rng.choice("abcdé😀") * rng.randint(1, 3) for _ in range(rng.randint(0, 90))) for i in ids}
    texts[ids[0]], texts[ids[1]] = None, ""
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, part int")
    got = {r.doc_id: r for r in minhash.compare_with_next(docs).collect()}
    order = sorted(ids, reverse=True)
    assert len(got) == len(ids)
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        a, b = texts[i] or "", texts[following] or ""
        k = len(a) // 3
        edited = a[: len(a) - k] + b[:k]
        s = minhash.signatures(pa.array([a, edited, b]))
        r = got[i]
        assert r.n_chars == len(a)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == minhash.as_text(s[0])
        assert r.edited_fingerprint == minhash.as_text(s[1])
        assert r.near_edited == (s[0] == s[1]).mean()
        assert r.near_next == (s[0] == s[2]).mean()
        assert len(base64.b64decode(r.fingerprint)) == 4 * minhash.PERMUTATIONS


def test_edge_tables(spark):
    kind = "doc_id long, text string"
    assert minhash.compare_with_next(spark.createDataFrame([], kind)).count() == 0
    one = minhash.compare_with_next(spark.createDataFrame([(3, "a b c")], kind)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(3, 1.0)]
    rows = [(None, "n"), (5, "same text"), (5, "same text"), (1, "x" * 100_000)]
    got = minhash.compare_with_next(spark.createDataFrame(rows, kind)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "5", "5", "None"]
    assert {r.near_next for r in got if r.doc_id == 5} >= {1.0}


def test_near_duplicate_classes(spark):
    rng = random.Random(3)
    texts = {}
    for g in range(30):
        base = [str(rng.randint(0, 10_000)) for _ in range(120)]
        for c in range(4):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "edit"
            texts[g * 10 + c] = " ".join(words)
    texts[900], texts[901], texts[902] = None, "", "short"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    label = {i: i for i in texts}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and jaccard(texts[i] or "", texts[j] or "") >= 0.8:
                label[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in texts}


def test_signatures_by_whole_numbers():
    """The permutations by unbounded integers, over the shingles' hashes."""
    text = "a rose is a rose is a rose"
    for _, data, offsets in textnum.chunks(pa.array([text]), 1 << 18):
        shingles, _ = textnum.shingle_hashes(*textnum.word_hashes(data, offsets), minhash.WIDTH)
    assert len(shingles) == 4 and len(set(shingles.tolist())) == 3
    want = [min((int(a) * int(h) + int(b)) % 2**64 for h in shingles) >> 32 for a, b in zip(minhash._A, minhash._B, strict=True)]
    assert minhash.signatures(pa.array([text]))[0].tolist() == want


def test_near_duplicates_of_odd_tables(spark):
    kind = "doc_id long, text string, node string, band string"
    assert minhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(3, "one two three four five six", "clash", None), (None, "one two three four five six", None, None), (1, None, None, None), (2, "", None, None), (None, "alone here", None, None)]
    got = sorted(((str(r.doc_id), r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert got == sorted([("3", 3), ("None", 3), ("1", 1), ("2", 1), ("None", None)], key=str)
