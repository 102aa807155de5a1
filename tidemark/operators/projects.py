"""Projects: settings resolution, choice of projects that may be searched together, and the registry as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The library's default embedding model, the reason for leaving a project out and the notice of it.
DEFAULT_EMBEDDING_MODEL = "text-embedding-3-small"
MISMATCH = "different embedding model"
NOTICE = f"%d of %d projects skipped — {MISMATCH}: %s"


def chosen(*values: Column) -> Column:
    """The first value that is a choice: neither NULL nor empty. False and 0 are choices."""
    return F.coalesce(*(F.when(v.cast("string") != "", v) for v in values))


def resolved_settings(projects: DataFrame, defaults: dict, library: dict) -> DataFrame:
    """`projects` with each field of `library` resolved: the project's choice, else the user's default, else the library's."""
    out = projects
    for field, last in library.items():
        first = [F.lit(defaults[field])] if defaults.get(field) not in (None, "") else []
        out = out.withColumn(field, F.coalesce(chosen(F.col(field), *first), F.lit(last)))
    return out


def distinct_projects(projects: DataFrame) -> DataFrame:
    """The first row of each id, by position."""
    rank = F.row_number().over(W.partitionBy("id").orderBy("position"))
    return projects.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def majority_model(projects: DataFrame) -> DataFrame:
    """One row, embedding_model: the most frequent, ties to the one that comes first."""
    counts = distinct_projects(projects).groupBy("embedding_model").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select("embedding_model")


def select_projects(projects: DataFrame, embedding_model: str | None = None) -> DataFrame:
    """Distinct projects with `included`: whether they use the target model, the majority's unless one is named."""
    unique = distinct_projects(projects)
    if embedding_model is not None:
        return unique.withColumn("included", F.col("embedding_model") == embedding_model)
    target = majority_model(projects).select(F.col("embedding_model").alias("target"))
    return unique.join(target, F.col("embedding_model") == F.col("target"), "left").withColumn("included", F.col("target").isNotNull()).drop("target")


def exclusions(selection: DataFrame) -> DataFrame:
    return selection.where(~F.col("included")).select("slug", F.lit(MISMATCH).alias("reason"), F.col("embedding_model").alias("detail"))


def selection_notice(selection: DataFrame) -> DataFrame:
    """One row, notice: what was skipped in the order given; empty where nothing was."""
    named = F.concat(F.col("slug"), F.when(F.col("embedding_model") != "", F.concat(F.lit(" ("), F.col("embedding_model"), F.lit(")"))).otherwise(""))
    gone = F.array_sort(F.collect_list(F.when(~F.col("included"), F.struct("position", named.alias("named")))))
    parts = selection.agg(F.count("*").alias("total"), F.count_if(~F.col("included")).alias("k"), F.array_join(F.transform(gone, lambda x: x["named"]), ", ").alias("list"))
    return parts.select(F.when(F.col("k") == 0, "").otherwise(F.format_string(NOTICE, "k", "total", "list")).alias("notice"))


def register(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """The registry with `entries` in place of entries of the same id."""
    return registry.join(entries.select("id"), "id", "left_anti").unionByName(entries)


def find(registry: DataFrame, key: str) -> DataFrame:
    """The first entry, by position, whose id or slug is `key`."""
    return registry.where((F.col("id") == key) | (F.col("slug") == key)).orderBy("position").limit(1)


def unregister(registry: DataFrame, key: str) -> DataFrame:
    """The registry without any entry whose id or slug is `key`."""
    return registry.where(~((F.col("id") == key) | (F.col("slug") == key)))
