"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import lean, written
from leafwork.llm.tokens import default_vocabulary, word_tokens

#: Lengths of a bucket of the suffix sums.
BUCKET = 4096


def histogram(docs: DataFrame, *groups: str, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Written (groups, length, documents): how many texts have so many tokens, no special tokens added.

    A null text is empty and has length 0. Rows may repeat and count each; null groups are groups. Whole texts
    are encoded; each batch is counted before it is shuffled. An empty table gives none.
    """
    path, n = vocabulary or default_vocabulary(), len(groups)
    kinds = "".join(f"`{g}` {docs.schema[g].dataType.simpleString()}, " for g in groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        for b in batches:
            step = max(1, min(b.num_rows, int(b.num_rows * (4 << 20) / max(1, b.nbytes))))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                texts = ["" if t is None else t for t in part.column(n).to_pylist()]
                lengths = pa.array([len(x) // words.width for x in words.encode(texts)], pa.int64())
                counted = pa.Table.from_arrays([*part.columns[:n], lengths], names=[*groups, "length"])
                counted = counted.group_by([*groups, "length"]).aggregate([([], "count_all")]).rename_columns([*groups, "length", "documents"])
                yield from counted.combine_chunks().to_batches()
        words.shrink()

    counted = docs.select(*groups, text).mapInArrow(lean(run), f"{kinds}length long, documents long")
    return written(counted.groupBy(*groups, "length").agg(F.sum("documents").alias("documents")), "lengths")


def with_suffix_sums(hist: DataFrame, *groups: str) -> DataFrame:
    """hist with tokens, documents_at_least and tokens_at_least (of this length or more) and truncated_total.

    truncated_total is the sum of min(length, limit) over all documents where
    the limit is this length. Sums over buckets of lengths are made apart from those within
    one, so no task sees all lengths.
    """
    hist = hist.withColumn("tokens", F.col("length") * F.col("documents")).withColumn("__b", F.floor(F.col("length") / BUCKET))
    sums = hist.groupBy(*groups, "__b").agg(F.sum("documents").alias("__d"), F.sum("tokens").alias("__t"))
    after = Window.partitionBy(*groups).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    zero = F.lit(0).cast("long")
    sums = sums.select(*groups, "__b", F.coalesce(F.sum("__d").over(after), zero).alias("__d"), F.coalesce(F.sum("__t").over(after), zero).alias("__t"), F.sum("__t").over(whole).alias("__all"))
    inner = Window.partitionBy(*groups, "__b").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    own = hist.withColumn("__di", F.sum("documents").over(inner)).withColumn("__ti", F.sum("tokens").over(inner))
    match = own["__b"] == sums["__b"]
    for g in groups:
        match = match & own[g].eqNullSafe(sums[g])
    docs, tokens = F.col("__di") + F.col("__d"), F.col("__ti") + F.col("__t")
    total = F.col("__all") - tokens + F.col("length") * docs
    return own.join(sums, match).select(*[own[g] for g in groups], "length", "documents", "tokens", docs.alias("documents_at_least"), tokens.alias("tokens_at_least"), total.alias("truncated_total"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, kept, cut, documents_cut): tokens within and beyond a context limit, for a few limits.

    sums is with_suffix_sums' result without groups.
    """
    rows = sums.withColumn("limit", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])))
    longer = F.col("length") > F.col("limit")
    out = rows.groupBy("limit").agg(F.sum("tokens").alias("all"), F.sum(F.when(longer, F.col("documents")).otherwise(0)).alias("documents_cut"), F.sum(F.when(longer, F.col("tokens")).otherwise(0)).alias("long"))
    cut = F.col("long") - F.col("limit") * F.col("documents_cut")
    return out.select("limit", (F.col("all") - cut).alias("kept"), cut.alias("cut"), "documents_cut")


def quantile(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length such that the share of documents has no more tokens."""
    sums = sums.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    total = sums.agg(F.max("documents_at_least")).first()[0] or 0
    rows = sums.where(total - F.col("documents_at_least") + F.col("documents") >= F.ceil(F.col("share") * total))
    return rows.groupBy("share").agg(F.min("length").alias("length"))

