"""Arrow helpers that the operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import materialise, release, scratch, table

__all__ = ["join_classes", "materialise", "release", "scratch", "sliced", "table", "texts_of"]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows, so that no more texts than those are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The whole texts of a batch; a null text counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


#: Rows of a class of equal rows from which on it is hot: a table has at most its rows / HOT such classes.
HOT = 100_000


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str = "size", hot: int = HOT) -> DataFrame:
    """`rows` with the columns of their class; `classes` has one row for each of `keys`, with its number of rows, `size`.

    Hot classes, of which there are few however large the table is, are sent to the rows, so no task gathers one; the
    others meet theirs by key.
    """
    heavy = F.broadcast(classes.where(F.col(size) >= hot).drop(size))
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(classes.where(F.col(size) < hot).drop(size), keys))
