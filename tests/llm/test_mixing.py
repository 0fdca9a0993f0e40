import re
from collections import Counter

import numpy as np
import pytest

from leafwork.llm import mixing

KIND = "doc_id long, text string, lang string, source string, n_chars long, row string"


def test_targets_stop_at_three_times_a_size():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    got = mixing.targets([10, 1000, 0, 500], [5, 2, 1, 5])
    assert got[0] == 30 and got[2] == 0
    assert sum(got) == pytest.approx(1510)
    assert got[1] / got[3] == pytest.approx(2 / 5)
    assert mixing.targets([], []) == []


def test_permutations_and_counts():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))
    rng, left = np.random.default_rng(0), np.array([5, 0, 100, 7])
    total = np.zeros(4, int)
    while (left - total).sum():
        total += mixing.draw_counts(rng, left - total, 9)
    assert total.tolist() == left.tolist()


def test_counts_of_shards_hang_on_the_seed_alone(monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 7)
    quotas = np.array([0, 40, 3, 0, 11, 1])
    whole = {k: (s.tolist(), f.tolist(), c.tolist()) for k, s, f, c in mixing.shard_counts(5, quotas, 0, 100)}
    assert sorted(whole) == list(range(8)) and all(sum(c) == 7 for k, (_, _, c) in whole.items() if k < 7)
    for begin, end in ((0, 3), (3, 4), (4, 8)):
        some = {k: (s.tolist(), f.tolist(), c.tolist()) for k, s, f, c in mixing.shard_counts(5, quotas, begin, end)}
        assert some == {k: whole[k] for k in range(begin, end)}
    done = np.zeros(6, int)
    for k in range(8):
        sources, first, counts = map(np.array, whole[k])
        assert (first == done[sources]).all()
        done[sources] += counts
    assert done.tolist() == quotas.tolist()


def make(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        n = int(rng.integers(0, 200)) if i % 50 else 5000
        source = [None, "b", "B", "é", "tiny"][int(rng.integers(4)) if i else 4]
        rows.append((i, " ".join(f"w{i}x{k}" for k in range(n)) if i % 97 else None, "en", source, 0, "clash"))
    rows.append(rows[7])
    return rows, spark.createDataFrame(rows, KIND)


def test_documents_of_a_mix(spark):
    rows, docs = make(spark)
    got = mixing.mix_counts(docs).collect()
    again = mixing.mix_counts(docs.repartition(7)).collect()
    assert len(got) == len(rows)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    other = mixing.mix_counts(docs).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(key, got)) == sorted(map(key, other))
    sizes = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    assert all(r.size == sizes[r.doc_id] and r.taken <= 3 * r.size for r in got)
    names = sorted({s for s in source.values() if s is not None}) + [None]
    by = Counter()
    for r in rows:
        by[r[3]] += sizes[r[0]]
    want = dict(zip(names, mixing.targets([by[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.source_size == by[source[r.doc_id]]
    for n in names:
        assert abs(taken[n] - want[n]) <= 2 * mixing.BLOCK
    mixed = Counter()
    for r in mixing.mixed_documents(docs).collect():
        mixed[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        assert r.text in next(x[1] for x in rows if x[0] == r.doc_id)
    total = Counter()
    for r in got:
        total[r.doc_id] += r.taken
    assert mixed == +total


def test_empty_tables(spark):
    assert mixing.mix_counts(spark.createDataFrame([], KIND)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], KIND)).count() == 0
    rows = [(1, None, None, None, None, None), (2, " ", None, "a", None, None)]
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.mix_counts(spark.createDataFrame(rows, KIND)).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
