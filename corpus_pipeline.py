"""The corpus pipeline: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, pii, simhash, toxicity
from tidemark.tables import materialise, release, scratch, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores as toxic go.

    Null and empty texts stay, repeated rows stay or go together, whole texts of any length are scored, columns may have
    any name; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the smallest doc_id, null last, of repeated ids the first read.

    Null and blank texts are one group; an empty table stays empty; columns may have any name.
    """
    return simhash.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows.

    Null texts stay null, and so does their n_chars; empty and repeated rows stay; a table without n_chars gets none.
    """
    clean = pii.redact_pii(docs, pii.fit_pii(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's repetition rate says, from no time to three.

    Null sources are a source; null and empty texts weigh nothing and go by their draw alone; rows that repeat id and text
    share a draw; an empty table stays empty; columns may have any name.
    """
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids: the columns of packing.pack, whatever those of docs are.

    Null and empty texts are one end id; long texts are cut; repeated rows are packed one by one; an empty table gives none.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", near_duplicates),
    ("pii", without_personal_data),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: SQL cannot express toxicity scores, personal-data spans or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote for itself goes when its result is written, and then its input
            last, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage_{name}", outer=True)
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
