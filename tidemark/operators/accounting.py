"""Prices, costs and the usage ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# List prices in USD for a million tokens, and their date.
PRICES_UPDATED = "2026-08-21"
PRICES = {
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4.1": (2.00, 8.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1-nano": (0.10, 0.40),
    "gpt-4-turbo": (10.00, 30.00),
    "gpt-3.5-turbo": (0.50, 1.50),
    "text-embedding-3-small": (0.02, None),
    "text-embedding-3-large": (0.13, None),
    "text-embedding-ada-002": (0.10, None),
}
PER = 1_000_000
#: Texts in one request to a provider of embeddings.
BATCH = 100

LEDGER = "provider string, model string, input_tokens bigint, output_tokens bigint, billable boolean, counted boolean"


def prices(spark: SparkSession) -> DataFrame:
    """model, input_price, output_price; no output price is NULL. Ten rows, so joins with it broadcast by size."""
    return spark.createDataFrame([(m, i, o) for m, (i, o) in PRICES.items()], "model string, input_price double, output_price double")


def priced_models(spark: SparkSession) -> DataFrame:
    return prices(spark).select("model").orderBy("model")


def with_prices(df: DataFrame) -> DataFrame:
    """`df` with the prices of its model; NULL where the model has none, which means unknown and never zero."""
    return df.join(prices(df.sparkSession), "model", "left")


def cost(tokens: Column, price: Column) -> Column:
    """Tokens at a price for a million; NULL if the price is."""
    return tokens / F.lit(float(PER)) * price


def with_record_cost(ledger: DataFrame) -> DataFrame:
    """The ledger with total_tokens and cost: 0 where not billable, NULL where a price that is needed is unknown."""
    into = cost(F.col("input_tokens"), F.col("input_price"))
    out = F.when(F.col("output_tokens") > 0, cost(F.col("output_tokens"), F.col("output_price"))).otherwise(F.lit(0.0))
    return (
        with_prices(ledger)
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
        .withColumn("cost", F.when(~F.col("billable"), F.lit(0.0)).otherwise(into + out))
        .drop("input_price", "output_price")
    )


def usage_totals(ledger: DataFrame) -> DataFrame:
    """One row: calls, token sums, estimated_cost of what is priced, and how many calls are unpriced or uncounted."""
    return with_record_cost(ledger).agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 8).alias("estimated_cost"),
        F.count_if(F.col("billable") & F.col("cost").isNull()).alias("unpriced_calls"),
        F.count_if(~F.col("counted")).alias("uncounted_calls"),
    )


def usage_by_model(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("model").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


def models_by_provider(ledger: DataFrame) -> DataFrame:
    """provider, place, model: the different models of each provider, numbered from 0 by name; NULL models are left out."""
    place = F.row_number().over(W.partitionBy("provider").orderBy("model")) - 1
    return ledger.where("model is not null").groupBy("provider", "model").count().select("provider", place.cast("bigint").alias("place"), "model")


def usage_summary(ledger: DataFrame) -> DataFrame:
    """One row with a line for people: calls, tokens, money with what is unpriced, and what wasn't counted."""
    t = usage_totals(ledger)
    calls = F.concat(F.col("calls").cast("string"), F.when(F.col("calls") == 1, " call").otherwise(" calls"))
    tokens = F.concat(F.format_number("total_tokens", 0), F.lit(" tokens"))
    money = F.concat(F.format_string("~$%.4f", "estimated_cost"), F.when(F.col("unpriced_calls") > 0, F.format_string(" (%d unpriced)", "unpriced_calls")).otherwise(""))
    missed = F.when(F.col("uncounted_calls") > 0, F.format_string("%d not counted", "uncounted_calls"))
    return t.select(F.when(F.col("calls") == 0, "no provider calls").otherwise(F.concat_ws(", ", calls, tokens, money, missed)).alias("summary"))


def embedding_batches(texts: DataFrame, size: int = BATCH) -> DataFrame:
    """batch, n_texts, tokens for texts with a position from 0 and tokens: what each request to a provider holds."""
    batch = F.floor(F.col("position") / size).cast("bigint")
    return texts.groupBy(batch.alias("batch")).agg(F.count("*").alias("n_texts"), F.sum("tokens").alias("tokens"))
