"""Bounded samples of labelled documents for fitting classifiers, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def labelled_ids(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """doc_id and label outside fold `held`: ids with a null label are left out; an id labelled twice has the larger label."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held))
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def sampling_weights(labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> tuple[float, float]:
    """How many labelled ids a row of training_rows stands for, of class 0 and of class 1; 1 where a class is not cut."""
    n = {r["label"]: r["count"] for r in labelled_ids(labels, label, folds, held).groupBy("label").count().collect()}
    return max(n.get(0, 0) / per_class, 1.0), max(n.get(1, 0) / per_class, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> DataFrame:
    """text and label of at most `per_class` documents of each class outside fold `held`.

    Labelled ids go by the hash of the id. Ids with a null label are left out; an id that is labelled twice counts with
    the larger label; of the documents that repeat an id, the one with the smallest hash of its text counts. Only ids
    are chosen before the join, so what is broadcast has at most 2 * per_class rows of two numbers, and as many rows
    come out, however often an id is repeated. A null text counts as empty.
    """
    rows = labelled_ids(labels, label, folds, held)
    chosen = None
    for kind in (0, 1):
        part = rows.where(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label")
