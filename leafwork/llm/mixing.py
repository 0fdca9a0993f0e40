"""Mixing sources to target weights, by permuted draws of fixed-length blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import WORD, lean, partitions, sums_before, word_count, written
from leafwork.llm.textnum import mix

WEIGHTS = (5.0, 2.0, 1.0)
#: No source, and so no document, is taken more often.
REPEATS = 3
BLOCK, SHARD, SEED = 64, 4096, 20240501
#: Documents of a bucket of the packing order, about.
BUCKET = 20_000
#: Sources whose table is broadcast, at most; more are joined by a shuffle.
BROADCAST = 10_000


def targets(sizes: list[int], weights: list[float], repeats: float = REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight; what passes repeats times a size is shared again."""
    sizes, weights = np.array(sizes, float), np.array(weights, float)
    out, free, left = np.zeros(len(sizes)), sizes > 0, float(sizes.sum())
    while free.any():
        share = weights * (left / weights[free].sum())
        over = free & (share > repeats * sizes)
        out[free] = np.where(over, repeats * sizes, share)[free]
        if not over.any():
            break
        left -= out[over].sum()
        free &= ~over
    return out.tolist()


def quota(size: int, target: float, block: int) -> int:
    """Blocks to draw: whole passes over the source, and the nearest number for the rest."""
    if size <= 0:
        return 0
    n, passes = -(-size // block), int(target // size)
    return passes * n + min(n, round((target - passes * size) / block))


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the given places: Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, 5, dtype=np.uint64) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return left << shift | right

    out = once(at.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def draw_counts(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Multinomial counts of n slots in proportion to what is left of each source, none above it."""
    out = np.zeros_like(left)
    while n > 0 and left.sum() > 0:
        found = np.minimum(rng.multinomial(n, left / left.sum()), left)
        out, left, n = out + found, left - found, n - int(found.sum())
    return out


def shard_counts(seed: int, quotas: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, sources, slots drawn of each before, slots drawn of each) of the shards from begin to before end.

    Counts are drawn down a tree: those of a range of shards are split into those of its halves, in
    proportion to the quotas that are left, by a generator that the range seeds. So a shard's counts hang on the
    quotas and the seed alone, whoever draws them, and all shards' counts sum up to the quotas.
    """
    sources = np.flatnonzero(quotas)
    todo = [(0, max(1, -(-int(quotas.sum()) // SHARD)), sources, np.zeros(len(sources), np.int64), quotas[sources])]
    while todo:
        low, high, sources, first, counts = todo.pop()
        if high <= begin or low >= end:
            continue
        if high - low == 1:
            yield low, sources, first, counts
            continue
        middle = (low + high) // 2
        left = draw_counts(np.random.default_rng((seed, low, high)), counts, SHARD * (middle - low))
        for a, b, own, before in ((middle, high, counts - left, first + left), (low, middle, left, first)):
            some = own > 0
            todo.append((a, b, sources[some], before[some], own[some]))


def permutation_key(seed: int, source: int, turn: int) -> int:
    x = np.array([seed], np.uint64)
    for v in (source, turn):
        x = mix(x + np.uint64(v + 1))
    return int(x[0]) & (1 << 62) - 1


@dataclass
class Mix:
    """docs: row, doc_id, source, number, size, start; sources: by number; slots: what is drawn."""

    docs: DataFrame
    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    quotas: list[int]
    block: int
    seed: int

    def slots(self) -> DataFrame:
        """(number, block, pass, shard): every draw of a block, by index permutation.

        Each task draws the counts of a range of shards. Two numbers a source are broadcast.
        """
        spark, quotas = self.docs.sparkSession, np.array(self.quotas, np.int64)
        blocks = np.array([-(-s // self.block) for s in self.sizes], np.int64)
        shards = max(1, -(-int(quotas.sum()) // SHARD))
        tasks = min(shards, 4 * partitions(spark))  # makes no difference to what is drawn
        shared, seed = spark.sparkContext.broadcast((quotas, blocks)), self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            quotas, blocks = shared.value
            for g in (g for b in batches for g in b.column(0).to_pylist()):
                for shard, sources, first, counts in shard_counts(seed, quotas, g * shards // tasks, (g + 1) * shards // tasks):
                    columns = []
                    for s, x, n in zip(sources.tolist(), first.tolist(), counts.tolist(), strict=True):
                        slot = np.arange(x, x + n)
                        turn, at, index = slot // blocks[s], slot % blocks[s], np.empty(n, np.int64)
                        for t in np.unique(turn).tolist():
                            index[turn == t] = permuted(at[turn == t], int(blocks[s]), permutation_key(seed, s, t))
                        columns.append(np.stack([np.full(n, s), index, turn, np.full(n, shard)]))
                    if columns:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(columns, 1)], names=["number", "block", "pass", "shard"])

        return spark.range(0, tasks, 1, tasks).mapInArrow(lean(run), "number long, block long, pass long, shard long")

    def pieces(self) -> DataFrame:
        """(number, block, row, first, words): the words of each document in each block."""
        end, b = F.col("start") + F.col("size"), F.col("block") * self.block
        rows = self.docs.where("size > 0").withColumn("block", F.explode(F.sequence(_div(F.col("start"), self.block), _div(end - 1, self.block))))
        first, last = F.greatest(b, F.col("start")), F.least(b + self.block, end)
        return rows.select("number", "block", "row", (first - F.col("start")).alias("first"), (last - first).alias("words"))

    def taken(self) -> DataFrame:
        """(row, pass, shard, first, words) of every piece of a document that is drawn."""
        return self.pieces().hint("merge").join(self.slots(), ["number", "block"]).select("row", "pass", "shard", "first", "words")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df broadcast if it has few rows; a source name each, they are a few MB."""
    return F.broadcast(df) if rows <= BROADCAST else df


def _div(x: Column, n: int) -> Column:
    return ((x - F.pmod(x, F.lit(n))) / n).cast("long")


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED) -> Mix:
    """Pack the words of docs (row, doc_id, source, size, order) into blocks and set each source's quota.

    Sources are numbered by code point, null last; one row a source reaches the
    driver. The order of a source's documents is that of a hash; its running
    sums are made in ranges of the hash, whose totals are summed up apart, so
    that no source's rows meet in one task. How many ranges there are makes no difference to the order.
    """
    spark = docs.sparkSession
    stats = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes = [r["source"] for r in stats], [r["size"] for r in stats]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], repeats)
    rows = sum(r["rows"] for r in stats)
    bits = max(1, max(4 * partitions(spark), rows // BUCKET).bit_length())
    numbers = spark.createDataFrame(list(enumerate(names)), "number long, named string")
    docs = docs.join(_small(numbers, len(names)), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    docs = docs.withColumn("bucket", F.shiftright("order", 63 - bits))
    # the order within a range of the hash, then that of the ranges
    inner = Window.partitionBy("number", "bucket").orderBy("order", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.withColumn("upto", F.sum("size").over(inner))
    sums = sums_before(docs.groupBy("number", "bucket").agg(F.max("upto").alias("total")), ["number"], "bucket", "total", 1 << bits // 2)
    docs = docs.join(sums, ["number", "bucket"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    docs = written(docs.select("row", "doc_id", "source", "number", "size", "start"), "packed")
    quotas = [quota(s, t, block) for s, t in zip(sizes, wanted, strict=True)]
    return Mix(docs, names, sizes, wanted, quotas, block, seed)


def measured(docs: DataFrame, text: bool = False) -> DataFrame:
    """Written rows (row, doc_id, source, size, order, and text and lang where asked)."""
    docs = docs.select("doc_id", "source", "text", *(["lang"] if text else []))
    extra = ["text", "lang"] if text else []
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("order"), *extra)
    return written(found, "measured")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (all in words).

    taken counts the words of the document that the mix takes, repeats
    included; they hang on the rows, the options and the seed, not on partitions or the cluster. Null text has
    size 0 and is never taken; a null source is a source of its own, after all others; equal rows stand for themselves, each with a place of its own in the
    packing. Other columns are not read. An empty table gives none.
    """
    plan = plan_mix(measured(docs), **options)
    taken = plan.taken().groupBy("row").agg(F.sum("words").alias("taken"))
    by_number = docs.sparkSession.createDataFrame([(i, s, t) for i, (s, t) in enumerate(zip(plan.sizes, plan.targets, strict=True))], "number long, source_size long, target double")
    rows = plan.docs.join(_small(by_number, len(plan.names)), "number").join(taken, "row", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: doc_id, text, lang, source, n_chars.

    Each pass over a source that takes all of a document's blocks gives the
    document as it is; one that takes some gives one row per run of blocks that
    border on each other, with the text from its first to its last
    word. Documents without words are never taken. Cases as in mix_counts.
    """
    whole = measured(docs, text=True)
    plan = plan_mix(whole.drop("text", "lang"), **options)
    runs = plan.taken().groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("runs"))
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pass", "runs"))).alias("passes"))
    rows = whole.join(runs, "row").select("doc_id", "text", "lang", "source", "size", F.transform("passes", lambda p: p["runs"]).alias("passes"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, lang string, source string, n_chars long"
    return rows.mapInArrow(lean(_cut), schema)


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    """(first, end) of runs of pieces that border on each other."""
    out: list[tuple[int, int]] = []
    for r in runs:
        if out and out[-1][1] == r["first"]:
            out[-1] = (out[-1][0], r["first"] + r["words"])
        else:
            out.append((r["first"], r["first"] + r["words"]))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = re.compile(WORD)
    for b in batches:
        rows: list[tuple] = []
        for doc_id, text, lang, source, size, passes in zip(*(c.to_pylist() for c in b.columns), strict=True):
            spans = None
            for runs in passes:
                for first, end in merged(runs):
                    cut = text
                    if end - first < size:
                        spans = spans or [m.span() for m in word.finditer(text)]
                        cut = text[spans[first][0] : spans[end - 1][1]]
                    rows.append((doc_id, cut, lang, source, len(cut)))
        if rows:
            columns = list(zip(*rows, strict=True))
            types = [b.schema.field("doc_id").type, pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text", "lang", "source", "n_chars"])

