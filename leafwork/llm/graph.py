"""Connected components of links in DataFrames, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, root long): every node of the links and one node of its component.

    Each round maps a node to the neighbour, or itself, of the smallest hash
    (another hash each round) and carries the links over to those. Stars and
    cliques collapse in one round and paths lose a constant share of their
    nodes, so the number of rounds follows the logarithm of the longest path.
    A hub's links are joined as written tables, whose hot partitions adaptive
    execution splits; the minimum over a hub's links is aggregated before it is
    shuffled. Nulls link nothing; links may repeat, in either direction.
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = F.xxhash64(F.lit(len(maps)), F.col("near"))
        near = both.select(F.col("a").alias("node"), F.col("b").alias("near"))
        own = both.select(F.col("a").alias("node"), F.col("a").alias("near"))
        to = written(near.union(own).groupBy("node").agg(F.min_by("near", order).alias("to")), "contracted")
        maps.append(to)
        edges = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        edges = edges.join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        edges = written(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].select("node", F.col("to").alias("root"))
    for to in reversed(maps[:-1]):
        above = roots.select(F.col("node").alias("to"), "root")
        roots = written(to.join(above, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return roots
