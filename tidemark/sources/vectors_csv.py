"""CSV files whose vector columns hold list literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import vector_from_text
from tidemark.operators.positions import with_position
from tidemark.tables import materialise


def read_embeddings_csv(spark: SparkSession, path: str, columns: list[str], **options: object) -> DataFrame:
    """A CSV with a header, quoted line breaks and doubled quotes, its `columns` as ARRAY<DOUBLE>; malformed ones are NULL."""
    df = spark.read.options(**{"header": True, "multiLine": True, "escape": '"', **options}).csv(path)
    return parse_embeddings(df, columns)


def parse_embeddings(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with its list-literal `columns` as vectors; the caller's frame is left as it is."""
    return df.withColumns({c: vector_from_text(F.col(c)) for c in columns})


def checked_embeddings(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The rows of `df` whose list-literal `columns` all parse, as vectors; the others as they came, quarantined; and counts.

    A literal is malformed where it is no list of numbers: cut off, with other text, or with a component that is null or
    missing. A NULL literal is none and parses to NULL. Quarantined rows keep their literals and say in `malformed` which
    columns are to blame. Rows are parsed in one pass that writes them and counts, as it goes, `rows`, `malformed` and
    `malformed_<column>`; both results read what it wrote.
    """
    parsed = {c: vector_from_text(F.col(f"`{c}`")) for c in columns}
    wrong = {c: F.col(f"`{c}`").isNotNull() & F.coalesce(v.isNull() | F.exists(v, lambda x: x.isNull()), F.lit(True)) for c, v in parsed.items()}
    blame = F.filter(F.array(*(F.when(w, F.lit(c)) for c, w in wrong.items())), lambda c: c.isNotNull())
    told = df.select(F.struct("*").alias("raw"), F.struct(*(v.alias(c) for c, v in parsed.items())).alias("vectors"), blame.alias("malformed"))
    seen = Observation()
    counts = [F.count_if(F.array_contains("malformed", c)).alias(f"malformed_{c}") for c in columns]
    rows = materialise(told.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("malformed") > 0).alias("malformed"), *counts), "checked_embeddings")
    good = rows.where(F.size("malformed") == 0).select(*(F.col(f"vectors.`{c}`" if c in parsed else f"raw.`{c}`").alias(c) for c in df.columns))
    return good, rows.where(F.size("malformed") > 0).select("raw.*", "malformed"), seen.get


def embedding_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the vector columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise AttributeError(f"no embeddings loaded for {', '.join(missing)}")
    return df.select(*columns)


def numbered_texts(df: DataFrame, column: str, *order: str) -> DataFrame:
    """position from 0 and text for a column of a table, in the given order: what load_text does with a list."""
    return with_position(df.select(*order, F.col(column).alias("__text")), *order).select("position", F.col("__text").alias("text"))


def load_text(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A list of texts as position and text."""
    if not isinstance(texts, list):
        raise TypeError("texts must be a list")
    return spark.createDataFrame(list(enumerate(texts)), "position bigint, text string")
