"""Files: whole texts, case lists, held-out conversations, function-call transcripts, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions import columns

MESSAGES = "messages array<struct<role:string,content:string>>, meta struct<shape:string,variation_seed:bigint,has_schema:boolean,mode:string,task:string,source:string,source_dataset:string>"
CALL = r"(?s)<functioncall>\s*(\{.*?\})\s*<\|endoftext\|>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(name, group, value as JSON) of a JSON array of cases; a missing key or a repeated name is an error on use."""
    cases = spark.read.schema("name string, group string, value variant").option("multiLine", True).json(path)
    broken = F.col("name").isNull() | F.col("group").isNull() | F.col("value").isNull()
    cases = cases.withColumn("name", F.when(broken, F.raise_error(F.lit("a case lacks name, group or value"))).otherwise(F.col("name")))
    repeated = cases.groupBy("name").agg(F.count("*").alias("n"))
    checked = repeated.select("name", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("case is named twice: "), F.col("name")))).otherwise(F.lit(True)).alias("__once"))
    return cases.join(checked, "name").where("__once").select("name", "group", F.to_json("value").alias("value"))


def read_holdout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(readable rows: text, value, shape; one row of counts): the last message of each conversation is its text."""
    rows = spark.read.schema(MESSAGES).json(path).select(F.element_at("messages", -1)["content"].alias("text"), F.col("meta.shape").alias("shape"))
    found = rows.withColumn("read", columns.decode(F.col("text")))
    good = found.where("read.ok").select("text", "shape", F.col("read.value").alias("value"))
    return good, found.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(F.col("read.ok"), F.lit(False))).alias("unreadable"))


def function_calls(df: DataFrame, chat: str, *keys: str) -> DataFrame:
    """(keys, n, name, arguments as JSON) of each call in a transcript; what is no JSON object is passed over.

    Arguments given as a string are read as JSON themselves.
    """
    calls = df.select(*keys, F.posexplode(F.regexp_extract_all(chat, F.lit(CALL), 1)).alias("n", "call"))
    calls = calls.withColumn("call", F.regexp_replace("call", r"'(\{.*\})'", '$1'))
    name, arguments = F.get_json_object("call", "$.name"), F.get_json_object("call", "$.arguments")
    return calls.select(*keys, "n", name.alias("name"), arguments.alias("arguments")).where(F.col("arguments").startswith("{") & F.try_parse_json("arguments").isNotNull())


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, one per row, nulls included."""
    df.write.option("ignoreNullFields", False).json(path)


def write_checkpointed(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key path doesn't hold yet, and read all back: a run that broke off goes on from there."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        df = df.join(done, key, "left_anti")
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)
