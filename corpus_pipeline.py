"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing and packing of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwork.llm import linededup, mixing, packing, simhash, toxicity
from leafwork.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language; the classifier is fitted on the labels table.

    Null texts are empty and scored too. Without labels every score is the same and below a threshold of its own. Rows may repeat.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with only the first line of each class of near-equal lines left in their texts, by doc_id and line number.

    Null texts stay null; blank lines stay. A document may be left with an empty text.
    """
    return linededup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group within 3 bits of the fingerprints of three-word shingles.

    Empty texts are alike. Documents without a doc_id stay.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, whole or the runs of blocks that it takes of them, as often as it takes them.

    Documents without words are never drawn. Null sources are one source.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids in sequences, with where they stand (see packing.packed)."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; each stage is written before the next reads it. An empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs


#: The classifier, covering hashes, permutations and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict = {}
