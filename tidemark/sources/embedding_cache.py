"""A cache of embeddings by the digest of their text, so that no text is asked for twice.

The table grows by appended files. What a run asks for is found among digests, in two steps: a Bloom filter of the digests
that are held, a table of its bits of bounded size, tells most new ones at once, and only those that it may hold meet the
digests themselves in an anti-join. The filter never rules out what is held, so the answer is exact however full it is.
Only then do the texts of the missing digests move.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.positions import with_position
from tidemark.sources.providers import EmbeddingProvider, UsageLog, embedded
from tidemark.tables import materialise

HELD = "digest string, embedding array<double>"
#: Bits of the filter, a power of two, and positions that a digest sets: two megabytes go to the tasks.
BITS, POSITIONS = 1 << 24, 4
WORD = 64
#: Digests that are sent to all tasks at most, some ten megabytes.
FEW = 1 << 16


def digest(text: Column) -> Column:
    """The SHA-256 of a text; NULL counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _places(key: Column, bits: int) -> Column:
    """POSITIONS bit positions of a key, by double hashing."""
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1))
    return F.array(*(F.pmod(F.shiftright(first, 20) + F.shiftright(second, 20) * i, F.lit(bits)) for i in range(POSITIONS)))


def bloom_filter(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """One row with `words`, the filter's bits by 64, for `keys` (digest): an aggregate by word, then bits / 64 numbers in order."""
    word, bit = F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))")
    filled = keys.select(F.explode(_places(F.col("digest"), bits)).alias("place")).groupBy(word).agg(F.bit_or(bit).alias("set"))
    every = keys.sparkSession.range(bits // WORD).withColumnRenamed("id", "word")
    rows = every.join(filled, "word", "left").agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("bigint")).alias("set")))).alias("rows"))
    return rows.select(F.transform("rows", lambda r: r["set"]).alias("words"))


def may_hold(df: DataFrame, words: DataFrame, bits: int = BITS) -> DataFrame:
    """`df` (digest, ...) with `maybe`: whether the filter may hold the digest; False is sure.

    The filter is one value of the plan that tasks look into; joined to the rows, its two megabytes would be copied for each.
    """
    filled = words.scalar()

    def set_at(place: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(WORD - 1)).cast("int"))
        return F.get(filled, F.shiftright(place, 6).cast("int")).bitwiseAND(bit) != 0

    placed = df.withColumn("__places", _places(F.col("digest"), bits))
    return placed.withColumn("maybe", reduce(Column.__and__, (set_at(F.get("__places", i)) for i in range(POSITIONS)))).drop("__places")


def _texts_of(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """`chosen` (digest, ...) with the `text` of each digest, from `texts` (text). Equal texts are one before they are shuffled.

    A few digests go to the tasks, so that only their texts are shuffled; else every different text is, once.
    """
    said = texts.select(digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    if chosen.count() <= FEW:
        said = said.join(F.broadcast(chosen.select("digest")), "digest", "left_semi")  # FEW digests at most
    return said.groupBy("digest").agg(F.first("text").alias("text")).join(chosen, "digest")


class EmbeddingCache:
    """Vectors by text digest below `root`, one folder a model."""

    def __init__(self, spark: SparkSession, root: str, model: str, bits: int = BITS) -> None:
        self.spark, self.path, self.bits = spark, f"{root.rstrip('/')}/{model}", bits
        spark.createDataFrame([], HELD).write.mode("ignore").parquet(self.path)

    def held(self) -> DataFrame:
        """digest, embedding: one row a digest, also where two writers have asked for the same text."""
        return self.spark.read.schema(HELD).parquet(self.path).groupBy("digest").agg(F.min("embedding").alias("embedding"))

    def missing(self, texts: DataFrame) -> DataFrame:
        """digest, text: the different texts of `texts` (text) that the cache doesn't hold."""
        return _texts_of(texts, materialise(self._missing_digests(texts), "missing_digests"))

    def _missing_digests(self, texts: DataFrame) -> DataFrame:
        """The digests of `missing`: no text is shuffled or written to find them."""
        asked = texts.select(digest(F.col("text")).alias("digest")).distinct()
        held = self.spark.read.schema(HELD).parquet(self.path).select("digest")
        told = materialise(may_hold(asked, bloom_filter(held, self.bits), self.bits), "asked_digests")
        return told.where("not maybe").unionByName(told.where("maybe").join(held, "digest", "left_anti")).select("digest")

    def embedded(self, texts: DataFrame, make: Callable[[UsageLog], EmbeddingProvider]) -> tuple[DataFrame, DataFrame]:
        """`texts` (id, text) as id and embedding, and the ledger of the requests that were needed.

        Equal texts are asked for once, and none that the cache holds. NULL counts as empty text; repeated ids each get
        their vector. The new vectors are in the cache before this returns.
        """
        names = materialise(with_position(self._missing_digests(texts), "digest").select(F.col("position").alias("id"), "digest"), "names")
        wanted = _texts_of(texts, names).withColumn("position", F.col("id"))
        vectors, uses = embedded(wanted.select("position", "id", "text"), make)
        vectors.join(names, "id").select("digest", "embedding").write.mode("append").parquet(self.path)
        keyed = texts.select("id", digest(F.col("text")).alias("digest"))
        return keyed.join(self.held(), "digest").select("id", "embedding"), uses
