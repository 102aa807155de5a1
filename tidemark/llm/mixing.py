"""Mixing sources to target weights by repetition rates, in DataFrame operations alone.

Tokens are aggregated by source, targets give repetition rates, and each document goes out floor(rate) times and once
more by a draw seeded by its hash. Draws are compared with a threshold that is the fraction as measured: of the draws of a
source in order, weighed by words, the two thresholds whose words lie next below and above what the fraction asks for, the
upper one with the probability that makes the expected words exactly those. That probability falls to a coin seeded by the
source. So a copy has the fraction's probability over seeds, in sources of one document as well, and in one mix the luck of
independent draws is taken out: a source is never further from its target than the documents of one draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise, release

MOST = 3
WEIGHTS = (1, 2, 3)
#: Steps of the draws: the resolution of a source's threshold, and rows a source of the table that sets it, at most.
STEPS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, rate for `sizes` (source, size).

    The sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share the sum of all sizes. A target stops
    at MOST times its source's size; the excess goes to the rest by weight until none is above. That is a common level
    L with target = least(weight * L, MOST * size): with the sources in the order of the level at which each is full,
    L follows from running sums. One row a source; the sort over them is the only unpartitioned step.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    kind = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1
    weighed = per.select("source", "source_size", F.element_at(F.array(*map(F.lit, WEIGHTS)), kind).cast("double").alias("weight"))
    cap = F.col("source_size").cast("double") * F.lit(float(MOST))
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = W.orderBy("full", F.col("source").isNull(), F.encode(F.col("source"), "UTF-8")).rowsBetween(W.unboundedPreceding, -1)
    running = (
        weighed.select("*", cap.alias("cap"), (cap / F.col("weight")).alias("full"))
        .select("*", F.sum(F.col("source_size").cast("double")).over(every).alias("total"), F.sum("weight").over(every).alias("weights"))
        .select("*", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("capped"), F.coalesce(F.sum("weight").over(upto), F.lit(0.0)).alias("capped_weight"))
        .select("*", ((F.col("total") - F.col("capped")) / (F.col("weights") - F.col("capped_weight"))).alias("level"))
    )
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(every)["level"]
    target = F.least(F.col("cap"), F.col("weight") * F.col("found"))
    return running.select("*", level.alias("found")).select(
        "source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")
    )


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 to STEPS - 1 from the MD5 of id, seed and text: the same in every run and engine."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit(""))))
    return F.pmod(F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("bigint"), F.lit(STEPS)).cast("int")


def coin(source: Column, seed: int) -> Column:
    """A number from 0 to below 1 from the MD5 of a source and the seed."""
    said = F.concat(F.coalesce(source.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def with_threshold(targets: DataFrame, draws: DataFrame, seed: int = 0) -> DataFrame:
    """`targets` (source, source_size, target, rate) with `least`: documents that draw less get one copy more.

    `draws` has source, draw, size: the words of each source by draw. Of the thresholds whose words lie next below and
    above what floor(rate) leaves of the target, the source's coin takes one, the upper one as often as makes the mean
    exactly that.
    """
    wanted = targets.select(F.col("source").alias("__source"), (F.col("target") - F.floor("rate") * F.col("source_size")).alias("wanted"))
    upto = W.partitionBy("source").orderBy("draw").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = draws.join(wanted, F.col("source").eqNullSafe(F.col("__source"))).select("source", "wanted", F.struct(F.sum("size").over(upto).cast("double").alias("words"), (F.col("draw") + 1).alias("least")).alias("step"))
    nothing = F.struct(F.lit(0.0).alias("words"), F.lit(0).alias("least"))
    below, above = F.col("step.words") <= F.col("wanted"), F.col("step.words") > F.col("wanted")
    ends = steps.groupBy("source").agg(F.coalesce(F.max(F.when(below, F.col("step"))), nothing).alias("low"), F.min(F.when(above, F.col("step"))).alias("high"), F.first("wanted").alias("wanted"))
    share = (F.col("wanted") - F.col("low.words")) / (F.col("high.words") - F.col("low.words"))
    cut = ends.select(F.col("source").alias("__source"), F.when(coin(F.col("source"), seed) < share, F.col("high.least")).otherwise(F.col("low.least")).alias("least"))
    return targets.join(cut, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def mixing_plan(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, the whole row, and its size, source_size, target, rate and copies, all but the first two begin with two underscores.

    copies is floor(rate) and one more where the document's draw is below its source's threshold; it depends on the
    id, the text, the seed and the source's totals only. Whole texts of any length count. Null text: size 0, drawn as empty. Rows that repeat both id and
    text share a draw; null and repeated ids with other texts draw apart. Sources without words have target 0; an empty
    table gives no rows. The counts of a source are pre-aggregated in each task, at most STEPS rows. The targets are
    written before the join, so Spark knows their size: while they are under its broadcast threshold the documents, and
    their texts, stay where they are; beyond it both sides are dealt out by source and a hot one is split.
    """
    sized = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), word_count(F.col("text")).alias("__size"), draw(F.col("doc_id"), F.col("text"), seed).alias("__draw"))
    draws = materialise(sized.groupBy("source", F.col("__draw").alias("draw")).agg(F.sum("__size").alias("size")), "source_draws")
    targets = materialise(with_threshold(source_targets(draws), draws, seed), "source_targets")
    release(draws)
    targets = targets.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"), F.col("least").alias("__least"))
    copies = F.floor("__rate") + (F.col("__draw") < F.col("__least")).cast("bigint")
    return sized.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("__copies", copies).drop("__draw", "__least")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: every document as often as its plan says, with the columns of `docs` (see mixing_plan).

    Rows travel whole beside the plan's columns, so `docs` may have columns of any name.
    """
    return mixing_plan(docs, seed).select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select("__row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':0:' || md5(coalesce(text, ''))), 1, 12)) AS BIGINT) % 4096 AS draw FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS DOUBLE) AS weight,
         CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS cap FROM per
), placed AS (
  SELECT *, cap / weight AS "full", CAST((SELECT sum(source_size) FROM per) AS DOUBLE) AS total, (SELECT sum(weight) FROM weighed) AS weights FROM weighed
), running AS (
  SELECT *, coalesce(sum(cap) OVER w, 0.0::DOUBLE) AS capped, coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS capped_weight FROM placed
  WINDOW w AS (ORDER BY "full", source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - capped) / (weights - capped_weight) AS level FROM running
), found AS (
  SELECT *, (SELECT level FROM levels WHERE level <= "full" ORDER BY "full", level LIMIT 1) AS l FROM levels
), targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * l), 0.0::DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN least(cap, weight * l) / source_size ELSE 0.0::DOUBLE END AS rate FROM found
), wanted AS (
  SELECT source, target, source_size, floor(rate) AS whole, target - floor(rate) * source_size AS wanted FROM targets
), drawn AS (
  SELECT source, draw, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY source, draw
), steps AS (
  SELECT d.source, w.wanted, d.draw + 1 AS least, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw) AS DOUBLE) AS words
  FROM drawn d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source
), low AS (
  SELECT source, max(words) AS low, arg_max(least, (words, least)) AS low_least FROM steps WHERE words <= wanted GROUP BY source
), high AS (
  SELECT source, min(words) AS high, arg_min(least, (words, least)) AS high_least FROM steps WHERE words > wanted GROUP BY source
), ends AS (
  SELECT w.source, w.wanted, coalesce(l.low, 0.0::DOUBLE) AS low, coalesce(l.low_least, 0) AS low_least, h.high, h.high_least,
         CAST(('0x' || substr(md5(coalesce(w.source, 'null') || ':0'), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS coin
  FROM wanted w LEFT JOIN low l ON w.source IS NOT DISTINCT FROM l.source LEFT JOIN high h ON w.source IS NOT DISTINCT FROM h.source
), cuts AS (
  SELECT source, CASE WHEN coin < (wanted - low) / (high - low) THEN high_least ELSE low_least END AS least FROM ends
)
SELECT s.doc_id, s.size, w.source_size, w.target, CAST(s.size * (w.whole + CASE WHEN s.draw < c.least THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""
