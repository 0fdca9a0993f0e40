"""Splitting by ranges of a key, and ranks within groups that no single task has to hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def splits(df: DataFrame, key: str, n: int) -> list:
    """At most n - 1 values that cut the non-null values of a numeric key into even parts.

    The driver gets n - 1 numbers whatever the size of df.
    """
    shares = [(i + 1) / n for i in range(n - 1)]
    if not shares:
        return []
    found = df.select(F.percentile_approx(key, shares, 100 * n).alias("q")).first()["q"]
    return sorted(set(found or []))


def part_of(key: Column, cuts: list) -> Column:
    """Number of cuts that are at most key; nulls come first, in part 0."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    every, coarse = (F.array(*[F.lit(c) for c in xs]) for xs in (cuts, cuts[step - 1 :: step] or cuts[:1]))
    most = F.size(F.filter(coarse, lambda c: c <= key)) if len(cuts) >= step else F.lit(0)
    fine = F.filter(F.slice(every, most * step + 1, step), lambda c: c <= key)
    return F.when(key.isNull(), F.lit(0)).otherwise(most * step + F.size(fine)).cast("int")


def rank_in_group(df: DataFrame, group: str | list[str], order: str, name: str = "rank") -> DataFrame:
    """df with a column: 0 for the first row of its group by a numeric order (nulls first), then 1, and so on.

    Rows are numbered within ranges of the order, and the ranges' counts are summed up
    apart: a group of a third of all rows is spread over as many tasks as any.
    """
    groups = [group] if isinstance(group, str) else list(group)
    names = df.columns
    df = df.withColumn("__part", part_of(F.col(order), splits(df, order, 4 * partitions(df.sparkSession))))
    counts = df.groupBy(*groups, "__part").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), (upto - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(order)) - 1
    match = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    ranked = df.withColumn("__own", own).join(counts, match)
    return ranked.select(*names, (F.col("__before") + F.col("__own")).cast("long").alias(name))
