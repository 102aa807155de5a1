"""Gapless numbers for the rows of a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import materialise

#: monotonically_increasing_id() keeps the place within a partition in these low bits.
PLACE_BITS = 33


def with_position(df: DataFrame, *order: str, name: str = "position", start: int = 0) -> DataFrame:
    """`df` with a bigint from `start` in the given order; ties keep the order of reading.

    The rows are range-partitioned and sorted once, each with its range and its place there, and that table is written:
    whatever a later plan prunes, coalesces or runs again, ranges stay as they are. Each range starts where the ranges
    before it end; the driver sees one count a range. Columns of `df` pass through; an empty table has no rows.
    """
    spark = df.sparkSession
    ranged = df.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(*order, "__read").sortWithinPartitions(*order, "__read")
    rows = materialise(ranged.drop("__read").withColumn("__at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__at", PLACE_BITS).alias("__part")
    first, starts = start, []
    for r in sorted(rows.groupBy(part).agg(F.count("*").alias("n")).collect()):
        starts.append((r["__part"], first))
        first += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "__part bigint, __first bigint"))  # a row a partition
    local = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    numbered = rows.withColumn("__part", F.shiftright("__at", PLACE_BITS)).join(offsets, "__part").withColumn(name, F.col("__first") + local)
    return numbered.select(*(c for c in df.columns if c != name), name)
