"""Shared helpers: written intermediate tables and splits of bounded size."""

from __future__ import annotations

import ctypes
import functools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.operators.ranges import part_of, partitions, splits
from leafwork.sources import scratch
from leafwork.sources.scratch import shared_dir

__all__ = ["bounded_batches", "drop_path", "drop_written", "fresh_path", "give_back", "lean", "part_of", "partitions", "running", "shared_dir", "splits", "sums_before", "table", "word_count", "written"]

#: Token of the word definition that every operator here shares.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Most bytes of a batch of rows for a Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch that goes to a Python worker, unless the session does: rows may hold very long texts."""
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(16 << 20))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for a table that a query writes on its way."""
    bounded_batches(spark)
    return scratch.fresh_path(spark, name)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back. codec: a faster one for what is read often.

    This cuts the lineage, so that lost executors cost no recomputation of what
    stands before, and a value such as monotonically_increasing_id() stays what
    it was. Joins of written tables have a plain exchange on each side, which
    adaptive execution can split when a key is hot.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Remove all tables that this application's written() has left in the shared folder, once no DataFrame needs them."""
    drop_path(spark, scratch.own_dir(spark))


def drop_path(spark: SparkSession, name: str) -> None:
    """Remove a folder, wherever Spark can write it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return this process's freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the system once its task is over: idle workers stay beside the next tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sums_before(sums: DataFrame, by: list[str], bucket: str, total: str, width: int) -> DataFrame:
    """(by, bucket, before): the sum of total over the buckets, numbered from 0, that precede in the group.

    Runs of width buckets are summed up first, so a task sees width of them, or as many runs as there are.
    """
    sums = sums.select(*by, bucket, F.col(total).alias("__sum"), F.floor(F.col(bucket) / width).alias("__run"))
    before = lambda x, *keys: F.coalesce(F.sum(x).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy(*by, "__run").agg(F.sum("__sum").alias("__sum"))
    runs = runs.select(*by, "__run", before("__sum", *by, "__run").alias("__first"))
    own = sums.select(*by, bucket, "__run", before("__sum", *by, "__run", bucket).alias("__own"))
    return own.join(runs, [*by, "__run"]).select(*by, bucket, (F.col("__first") + F.col("__own")).cast("long").alias("before"))


def running(df: DataFrame, by: Column, value: Column, *order: str) -> DataFrame:
    """df with before: the sum of value over the rows that precede in the row's group.

    Rows are dealt to buckets by the hash of order, which has to tell rows apart, and
    follow each other by bucket and then by order. Each bucket is summed up on its own and the
    buckets' totals apart, in two levels, so that no group meets in one task. Groups are not null.
    """
    n = 4 * partitions(df.sparkSession)
    names = df.columns
    df = df.select("*", by.alias("__by"), value.cast("long").alias("__value"), F.pmod(F.xxhash64(*order), F.lit(n)).alias("__bucket"))
    sums = df.groupBy("__by", "__bucket").agg(F.sum("__value").alias("__sum"))
    sums = sums_before(sums, ["__by"], "__bucket", "__sum", math.isqrt(n) + 1).withColumnRenamed("before", "__first")
    inner = Window.partitionBy("__by", "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__upto", F.sum("__value").over(inner)).join(sums, ["__by", "__bucket"])
    return df.select(*names, (F.col("__first") + F.col("__upto") - F.col("__value")).alias("before"))
