"""The corpus operators as queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import embeddings, linededup, minhash, mixing, packing, simhash, tokencounts, toxicity, urlrep, warc
from leafwork.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op2_warc_segments"] = warc.ROUND_TRIP_SQL


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


@query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op4_embedding_near_dedup"] = embeddings.near_duplicates_sql()


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.with_suffix_sums(tokencounts.histogram(table(spark, sf_dir, "documents")))


@query
def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrep.judge(table(spark, sf_dir, "pages"))


ORACLES["op6_url_reputation"] = urlrep.judge_sql()


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicate(table(spark, sf_dir, "documents"))


@query
def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))
