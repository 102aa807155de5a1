"""Exact top-k search by integer inner products, with norm-sorted blocks and pruning by Cauchy-Schwarz bounds.

Candidates are put in order by bands of length, the longest first, within a band by the nearest centroid of their leading
coordinates after a rotation by the singular vectors of a sample, and cut into blocks. A block knows its longest vector, the
box of its leading coordinates and the longest rest. What a query can score in a block is at most its best corner of the
box plus the product of the lengths of the rests, and at most the product of the lengths. Queries travel in blocks with a
lower bound of each one's k-th score from the longest vectors of all; they first meet a directory of what blocks know, a
row for each DIRECTORY blocks, and then go only to the blocks that they can find something in. A task meets queries with
one block of candidates: it stops where |q| |c| falls below every query's bound, computes the leading coordinates, and
only where the partial sum plus the product of the residual lengths reaches the bound is the exact integer product taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise
from tidemark.llm.vectors import k_means, packed, unpacked, usable

SCALE, EVERY, K = 64, 20, 20
#: Vectors in a block of candidates and of queries, and candidates that are bounded at once within a block.
CANDIDATES, QUERIES, STEP = 4096, 1024, 512
#: Longest vectors that give the first bounds, and sampled vectors that give rotation and centroids: what is sent to all tasks.
HEAD, SAMPLE, LEADING = 2048, 2048, 16
#: Centroids at most, the factor between the lengths of a band, and vectors from which on a block ends with its centroid's.
CENTROIDS, BAND, LEAST_BLOCK = 256, 1.1, 256
#: Blocks in one row of the directory.
DIRECTORY = 1024
EXACT = float(1 << 53)


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of q with all rows of c (by floats where those are exact)."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < float(1 << 62):
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _small(x: np.ndarray) -> np.ndarray:
    """x in the narrowest integer type that holds it."""
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if x.size == 0 or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max)))


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its `k` highest scores, ties to the smaller vec_id.

    `vectors` has vec_id and embedding. A component x counts as floor(scale * x); queries are the rows whose vec_id is
    divisible by `every`; candidates are all other rows, also such as repeat a query's vec_id or vector. Rows with a
    null vec_id, or a vector that is null, empty or holds null or non-finite components, take no part. Vectors of
    different lengths are compared as if the shorter went on with zeros. Scores beyond 64 bits are held at the bounds
    of a long. No rows, no result.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("q"), F.monotonically_increasing_id().alias("row")
    )
    rows = rows.select("vec_id", "q", "row", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm"))
    rows = materialise(rows, "topk_vectors")
    n, width, asked_rows, longest = rows.agg(F.count("*"), F.max(F.size("q")), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max("norm")).first()
    width = width or 1
    sample = _matrix([r["q"] for r in rows.where(F.pmod(F.xxhash64("row"), F.lit(max(n, SAMPLE))) < SAMPLE).select("q").collect()], width).astype(float)  # some SAMPLE rows
    rotation = np.linalg.svd(sample.T @ sample)[2].T if len(sample) else np.eye(width)  # the sample's right singular vectors
    lead = min(LEADING, width)
    centroids = k_means(sample @ rotation[:, :lead], min(CENTROIDS, max(1, n // CANDIDATES))) if len(sample) else np.zeros((1, lead))
    head_rows, head_q = _head(rows, n, max(HEAD, k + 1), width)
    parts, asked_parts = max(1, -(-n // CANDIDATES)), max(1, -(-asked_rows // QUERIES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The band of a vector's length and its centroid."""
        for b in batches:
            x = _matrix(b.column("q").to_pylist(), width).astype(float) @ rotation[:, :lead]
            near = np.concatenate([((x[at : at + 1024, None, :] - centroids) ** 2).sum(2).argmin(1) for at in range(0, len(x), 1024)]) if len(x) else np.empty(0)
            with np.errstate(divide="ignore"):
                band = np.minimum(np.log(longest / b.column("norm").to_numpy()) / math.log(BAND), 1e6)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(band.astype(np.int32)), pa.array(near.astype(np.int32))], names=[*b.schema.names, "band", "near"])

    def arrays_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, rows and vectors, longest first."""
        ids, row, q = zip(*rows, strict=True)
        order = np.lexsort((row, ids, -np.array([sum(float(x) * x for x in v) for v in q])))
        return np.array(ids, np.int64)[order], np.array(row, np.int64)[order], _small(_matrix(list(q), width)[order])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, key, waiting = 0, None, []

        def out() -> pa.RecordBatch:
            found = arrays_of(waiting)
            turned = found[2].astype(float) @ rotation
            told = [float(np.linalg.norm(turned, axis=1).max()), turned[:, :lead].min(0).tolist(), turned[:, :lead].max(0).tolist(), float(np.linalg.norm(turned[:, lead:], axis=1).max())]
            kinds = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.binary())
            values = [(TaskContext.get().partitionId() << 32) + made, *told, packed(*found)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["part", "most", "low", "high", "rest", "block"])

        for b in batches:
            for i, r, q, *new in zip(*(b.column(c).to_pylist() for c in ("vec_id", "row", "q", "band", "near")), strict=True):
                if waiting and (len(waiting) == CANDIDATES or (new != key and len(waiting) >= LEAST_BLOCK)):
                    yield out()
                    made, waiting = made + 1, []
                key = new
                waiting.append((i, r, q))
        if waiting:
            yield out()

    kinds = "vec_id bigint, q array<bigint>, row bigint, norm double, band int, near int"
    order = (F.col("band"), F.col("near"), F.desc("norm"), F.col("vec_id"), F.col("row"))
    blocks = materialise(rows.mapInArrow(place, kinds).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(hold, "part bigint, most double, low array<double>, high array<double>, rest double, block binary"), "topk_blocks")
    groups = max(1, -(-blocks.count() // DIRECTORY))
    directory = blocks.groupBy(F.pmod(F.xxhash64("part"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("part", "most", "low", "high", "rest")).alias("held"))  # some DIRECTORY blocks

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries in blocks, each with its bound."""
        waiting: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, row, matrix = arrays_of(waiting)
            bound = np.full(len(ids), np.iinfo(np.int64).min)
            for at in range(0, len(ids), 256):
                scores = _products(matrix[at : at + 256].astype(np.int64), head_q.astype(np.int64))
                others = head_rows[None, :] != row[at : at + 256, None]
                for i in range(len(scores)):
                    own = scores[i][others[i]]
                    if len(own) >= k:
                        bound[at + i] = np.partition(own, len(own) - k)[len(own) - k]
            return pa.RecordBatch.from_arrays([pa.array([packed(ids, row, matrix, bound)], pa.binary())], names=["asking"])

        for b in batches:
            for q in zip(*(b.column(c).to_pylist() for c in ("vec_id", "row", "q")), strict=True):
                waiting.append(q)
                if len(waiting) == QUERIES:
                    yield out()
                    waiting.clear()
        if waiting:
            yield out()

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block of the directory, those of some queries that can find something in it."""
        for b in batches:
            for asking, held in zip(b.column("asking").to_pylist(), b.column("held").to_pylist(), strict=True):
                ids, row, matrix, bound = unpacked(asking)
                can = _reach(matrix.astype(float) @ rotation, bound, held, lead)
                for j in np.flatnonzero(can.any(0)).tolist():
                    who = np.flatnonzero(can[:, j])
                    yield pa.RecordBatch.from_arrays([pa.array([held[j]["part"]], pa.int64()), pa.array([packed(ids[who], row[who], matrix[who], bound[who])], pa.binary())], names=["part", "asked"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked, held in zip(b.column("asked").to_pylist(), b.column("block").to_pylist(), strict=True):
                yield _meet(unpacked(asked), unpacked(held), rotation, k)

    queries = rows.where(F.col("vec_id") % every == 0).mapInArrow(place, kinds).repartitionByRange(asked_parts, *order).sortWithinPartitions(*order)
    asking = queries.mapInArrow(ask, "asking binary").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asking.withColumn("group", F.col("group").cast("bigint")).join(directory, "group").select("asking", "held").mapInArrow(reach, "part bigint, asked binary")
    found = asked.join(blocks.select("part", "block"), "part").select("asked", "block").mapInArrow(meet, "query_id bigint, query_row bigint, vec_id bigint, row bigint, score bigint")
    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _head(rows: DataFrame, n: int, most: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of some `most` of the longest rows; of many rows of one length, some by hash."""
    if n > most:
        least = rows.agg(F.percentile_approx("norm", 1 - most / n, 10_000)).first()[0]
        long = rows.where(F.col("norm") >= least)
        among = max(long.count(), most)
        rows = long.where(F.pmod(F.xxhash64("row"), F.lit(among)) < most)
    head = rows.select("row", "q").collect()
    return np.array([r["row"] for r in head], np.int64), _small(_matrix([r["q"] for r in head], width))


def _reach(turned: np.ndarray, bound: np.ndarray, held: list, lead: int) -> np.ndarray:
    """Which queries, after the rotation, can score their bound in which of the blocks; slack covers rounding."""
    low, high = (np.array([h[c] for h in held]) for c in ("low", "high"))
    most, rest = (np.array([h[c] for h in held]) for c in ("most", "rest"))
    lengths, own_rest = np.linalg.norm(turned, axis=1), np.linalg.norm(turned[:, lead:], axis=1)
    box = np.maximum(turned[:, :lead], 0) @ high.T + np.minimum(turned[:, :lead], 0) @ low.T + np.outer(own_rest, rest)
    whole = np.outer(lengths, most)
    least = np.where(bound == np.iinfo(np.int64).min, -np.inf, bound.astype(float))
    return np.minimum(box, whole) + 1e-9 * whole + 1e-6 >= least[:, None]


def _meet(asked: tuple, held: tuple, rotation: np.ndarray, k: int) -> pa.RecordBatch:
    """The up to k best candidates of a block for each query of a block that reach the query's bound."""
    query_id, query_row, q, bound = asked
    ids, row, c = held
    q, c, bound = q.astype(np.int64), c.astype(np.int64), bound.copy()
    lead = min(LEADING, q.shape[1])
    rq, rc = q.astype(float) @ rotation, c.astype(float) @ rotation
    q_norm, c_norm = np.linalg.norm(rq, axis=1), np.linalg.norm(rc, axis=1)
    q_rest, c_rest = np.linalg.norm(rq[:, lead:], axis=1), np.linalg.norm(rc[:, lead:], axis=1)
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
    for at in range(0, len(c), STEP):
        part = slice(at, at + STEP)
        slack = 1e-9 * q_norm * c_norm[at] + 1e-6
        # A score held at the least long may stand for any smaller sum, so that bound excludes nothing.
        least = np.where(bound == np.iinfo(np.int64).min, -np.inf, bound.astype(float))
        awake = np.flatnonzero(q_norm * c_norm[at] + slack >= least)
        if not len(awake):
            break
        most = rq[awake, :lead] @ rc[part, :lead].T + np.outer(q_rest[awake], c_rest[part]) + slack[awake, None]
        hopeful = (most >= least[awake, None]) & (row[None, part] != query_row[awake, None])
        live = np.flatnonzero(hopeful.any(1))
        if not len(live):
            continue
        scores = _products(q[awake[live]], c[part])
        for i, one in zip(live, scores, strict=True):
            who = awake[i]
            good = np.flatnonzero(hopeful[i] & (one >= bound[who]))
            if len(good):
                s, p = np.concatenate([best[who][0], one[good]]), np.concatenate([best[who][1], at + good])
                if len(s) > k:
                    order = np.lexsort((row[p], ids[p], -s))[:k]
                    s, p = s[order], p[order]
                    bound[who] = max(bound[who], s[-1])
                best[who] = (s, p)
    counts = [len(s) for s, _ in best]
    score, place = np.concatenate([s for s, _ in best]), np.concatenate([p for _, p in best])
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_id, counts)), pa.array(np.repeat(query_row, counts)), pa.array(ids[place]), pa.array(row[place]), pa.array(score)], names=["query_id", "query_row", "vec_id", "row", "score"])


#: The same in DuckDB's dialect, for vectors of one width.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
