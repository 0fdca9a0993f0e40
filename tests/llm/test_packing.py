import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from leafwork.llm import cutting_stock, packing
from leafwork.llm.tokens import default_vocabulary, word_tokens

KIND = "doc_id long, text string, row string, tokens string"


def ids_of(text):
    found = word_tokens(default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array([*found, 2], "<u4")


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(2)
    tokens = word_tokens(default_vocabulary())
    pool = "abcXYZéÉñßÇü.,;:!?'’-_12 \n\t\r\xa0\u2028ΣσςİıǅЖ字ｱ\u0301😀ﬁ<|>'st"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 16))) for _ in range(6000)] + ["a<|endoftext|>b", "don't <|endoftext|>,"]
    for text, got in zip(texts, tokens.encode(texts), strict=True):
        assert got == ids_of(text)[:-1].astype(tokens.dtype).tobytes(), text


@pytest.mark.parametrize("seed", range(3))
def test_cutting_stock(seed):
    rng = np.random.default_rng(seed)
    demand = np.zeros(64, int)
    for _ in range(300):  # so 300 sequences hold all, without any gap
        cuts = np.unique(np.r_[0, rng.integers(1, 64, 3), 64])
        np.add.at(demand, np.diff(cuts) - 1, 1)
    patterns = cutting_stock.solve(demand, 64)
    used = sum((n * c for n, c in patterns), np.zeros(64, int))
    sizes = np.arange(1, 65)
    assert (used <= demand).all()
    assert all((c * sizes).sum() <= 64 for _, c in patterns)
    assert sum(n for n, _ in patterns) <= 303
    assert (used * sizes).sum() == 300 * 64
    assert cutting_stock.solve(np.zeros(8, int), 8) == []


@pytest.mark.parametrize("length", [64, 256])
def test_every_id_is_in_one_piece(spark, length):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma.", "ñu"]) for _ in range(rng.randint(0, 90))), "clash", None) for i in range(150)]
    rows += [(900, None, None, None), (901, "", None, None), (902, "long " * 3000, None, None), (None, "x y", None, None), (5, "x y", None, None)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, KIND)
    got = packing.packed(docs, length=length, unit=4, ids=True).collect()
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
    for parts in sequences.values():
        parts.sort()
        ends = [o + n for o, n in parts]
        assert [o for o, _ in parts] == [0, *ends[:-1]]
        assert ends[-1] == length or ends[-1] & (ends[-1] - 1) == 0
    wanted = defaultdict(list)
    for doc_id, text, *_ in rows:
        wanted[doc_id].append(ids_of(text).tobytes())
    for doc_id, texts in wanted.items():
        if len(texts) == 1:
            parts = sorted(pieces[doc_id])
            assert b"".join(p[2] for p in parts) == texts[0]
            assert {p[3] for p in parts} == {len(texts[0]) // 4}
        assert sum(p[1] for p in pieces[doc_id]) == sum(len(t) // 4 for t in texts)


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], KIND)).count() == 0


def fewest(sizes, capacity):
    """Least number of sequences that hold all sizes, by trying every deal."""
    best = [len(sizes)]

    def deal(i, free):
        if len(free) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(free)
            return
        for k in {f: k for k, f in enumerate(free) if f >= sizes[i]}.values():
            deal(i + 1, [*free[:k], free[k] - sizes[i], *free[k + 1 :]])
        deal(i + 1, [*free, capacity - sizes[i]])

    deal(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(20))
def test_patterns_against_every_deal(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 12) for _ in range(9)), reverse=True)
    demand = np.bincount(sizes, minlength=13)[1:]
    patterns = cutting_stock.solve(demand, 12)
    assert sum((n * c for n, c in patterns), np.zeros(12, int)).tolist() == demand.tolist()
    assert all((c * np.arange(1, 13)).sum() <= 12 for _, c in patterns)
    assert sum(n for n, _ in patterns) <= fewest(sizes, 12) + 1


def test_gaps_are_filled(spark):
    rng = np.random.default_rng(1)
    lengths = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(60, 110, 500))], "row long, tokens long")
    got = packing.plan(lengths, 128, 4).collect()
    assert {r.placed_by for r in got} == {"pattern", "fill", "laid"}
    assert sum(r.size for r in got if r.placed_by == "pattern") > 0.7 * sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.size))
    for parts in by.values():
        parts.sort()
        ends = [o + n for o, n in parts]
        assert [o for o, _ in parts] == [0, *ends[:-1]]
        assert ends[-1] == 128 or ends[-1] & (ends[-1] - 1) == 0
    pieces = defaultdict(list)
    for r in got:
        pieces[r.row].append((r.start, r.size))
    for r in lengths.collect():
        own = sorted(pieces[r.row])
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]] and sum(n for _, n in own) == r.tokens
