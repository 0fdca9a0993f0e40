"""Joins and orders that the evaluation of documents needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.operators.ranges import rank_in_group


def unknown(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested rows whose key isn't known."""
    return requested.join(known, key, "left_anti")


def chosen(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return df.join(wanted, key, "left_semi")


def trial_grid(spark, **axes: list) -> DataFrame:
    """Every combination of a few given values per axis, made by exploding arrays."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def ranked_order(df: DataFrame, ranks: dict[str, list], *then: str) -> DataFrame:
    """df sorted by the places of its values in given lists (others last), then by columns."""
    keys = []
    for name, values in ranks.items():
        place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name))
        keys.append(F.when(place > 0, place).otherwise(F.lit(len(values) + 1)))
    return df.orderBy(*keys, *then)


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """Each key with the position at which it is first seen, in that order."""
    return df.groupBy(key).agg(F.min(position).alias("first_position")).orderBy("first_position")


def occurrence(df: DataFrame, *keys: str, order: str) -> DataFrame:
    """df with occurrence: 0 for the first row of its keys by a numeric order, then 1, and so on."""
    return rank_in_group(df, list(keys), order, "occurrence")


def headers_as_of(lines: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Table rows with the columns of the last header of their prefix that stands before them.

    lines is text_leaves' result. An as-of join on the line's position.
    """
    prefix = F.when(F.col("kind") == "header", F.col("key")).otherwise(F.regexp_extract("key", r"^(.+)\[[0-9]+\]\z", 1))
    w = Window.partitionBy(doc, "prefix").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = lines.withColumn("prefix", prefix).withColumn("columns", F.last(F.when(F.col("kind") == "header", F.col("cells")), ignorenulls=True).over(w))
    return named.where((F.col("kind") == "row") & F.col("columns").isNotNull())
