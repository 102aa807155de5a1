"""Weighted random samples by group, without replacement, in one pass."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Intermediate groups that the reservoirs of tasks are merged in before the last merge.
MERGES = 64


def priority(key: Column, weight: Column, seed: int = 0) -> Column:
    """-ln(u) / weight for a u from the MD5 of key and seed: the rows with the least are a sample by weight.

    That is the order of u^(1/weight) from above. NULL, and so in no sample, where the weight isn't above 0.
    """
    said = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    u = (F.conv(F.substring(said, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))
    return F.when((weight > 0) & (weight < float("inf")), -F.log(u) / weight.cast("double"))


def weighted_sample(df: DataFrame, group: str, key: str, weight: str | Column, k: int, seed: int = 0) -> DataFrame:
    """At most `k` rows of each `group`, drawn without replacement with chances by `weight`, the same for the same seed.

    Each task keeps a reservoir of the k least priorities a group while it reads, so k rows a group and task are all
    that is shuffled; reservoirs merge by the same rule, MERGES at a time and then all of a group. Rows that repeat a key
    share its luck and tie by their order of reading; rows without a key or a positive weight are never drawn; NULL is a
    group. The columns are those of `df`, whatever their names. ValueError for a negative k.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    share = F.col(weight) if isinstance(weight, str) else weight
    drawn = df.select(F.struct("*").alias("row"), F.col(group).alias("group"), priority(F.col(key), share, seed).alias("priority")).where("priority is not null")
    kinds = {f.name: f.dataType.simpleString() for f in drawn.schema.fields}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, pa.Table] = {}
        for b in batches:
            places = defaultdict(list)
            for i, g in enumerate(b.column("group").to_pylist()):
                places[g].append(i)
            for g, at in places.items():
                part = pa.Table.from_batches([b]).take(at)
                part = pa.concat_tables([held[g], part]) if g in held else part
                order = np.argsort(part.column("priority").to_numpy(), kind="stable")[:k]
                held[g] = part.take(order).combine_chunks()
        task = TaskContext.get().partitionId()
        for part in held.values():
            for b in part.to_batches():
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, task), pa.int64())], names=[*b.schema.names, "task"])

    kept = drawn.mapInArrow(keep, f"row {kinds['row']}, `group` {kinds['group']}, priority double, task bigint")
    for parts in (["group", F.col("task") % MERGES], ["group"]):
        least = F.row_number().over(W.partitionBy(*parts).orderBy("priority", "task"))
        kept = kept.withColumn("place", least).where(F.col("place") <= k).drop("place")
    return kept.select("row.*")
