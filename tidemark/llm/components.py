"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node that has an edge; component is the smallest node reachable.

    `edges` has two bigint columns, src and dst, in either direction, repeats allowed. Every round hangs neighbours on
    the smallest neighbour by a grouped minimum (partial aggregation) and a join that AQE may split where a hub is
    hot; it ends when no edge changes. Rounds grow with the logarithm of the longest path. Each round's edges are a
    table in the shared folder, deleted with the next one; only their count and checksum reach the driver. Empty input: no rows. Null ends and
    self loops are ignored.
    """
    linked = edges.where("src is not null and dst is not null and src <> dst")
    current = materialise(linked.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    before = _signature(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, current = current, materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(last)
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
