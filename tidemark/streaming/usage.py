"""The usage ledger as a stream: totals by hour and model, whatever order and batches its records come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.accounting import with_record_cost

#: How late a record may come, and a repeated one after the first, by its own time.
LATENESS = "2 days"
TOTALS = ("calls", "input_tokens", "output_tokens", "estimated_cost", "unpriced_calls", "uncounted_calls")


def hourly_usage(calls: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """hour, model and totals of a stream of calls (call_id, at timestamp, and the ledger's columns), each call once.

    A call that is told again within `lateness` counts once; one that comes later than that behind the newest is left
    out, as is one without a time or from 1970's first moment, where Spark's watermarks begin. State is kept for the calls and hours of that span alone.
    """
    once = calls.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["call_id"])
    hour = F.window("at", "1 hour")["start"].alias("hour")
    return (
        with_record_cost(once)
        .groupBy(hour, "model")
        .agg(
            F.count("*").alias("calls"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.coalesce(F.sum("cost"), F.lit(0.0)).alias("estimated_cost"),
            F.count_if(F.col("billable") & F.col("cost").isNull()).alias("unpriced_calls"),
            F.count_if(~F.col("counted")).alias("uncounted_calls"),
        )
    )


def stream_usage(calls: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS) -> StreamingQuery:
    """Starts a query that keeps the totals of `calls` below `path`: each micro-batch appends the hours that it changed.

    A micro-batch that runs again writes its own folder again, so its rows are there once.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = hourly_usage(calls, lateness).writeStream.outputMode("update").foreachBatch(put)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """hour, model and totals as the last micro-batch that changed them left them."""
    latest = F.row_number().over(W.partitionBy("hour", "model").orderBy(F.desc("batch")))
    rows = spark.read.parquet(path).withColumn("__place", latest).where("__place = 1")
    return rows.select("hour", "model", *TOTALS)
