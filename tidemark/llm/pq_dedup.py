"""Near-duplicate vectors by product quantisation.

Vectors are scaled to length one, filed in the inverted list of the nearest of some coarse centroids, and the residual is
coded by subspace; list, codes and coding error are computed once and written. A vector then probes lists, by an
equi-join on label and list:

* probes: a vector x links with some y of list c only if x is within reach of it, that is if
  |x-c|^2 - |x-c0|^2 <= 2 r |c-c0| for x's own centroid c0 (else the plane between the centroids is farther than the
  linking distance r). That many probes are sufficient: none that could hold a link is left out. The test holds for both
  ends of a link, so a vector asks its own list and those after it only.
* table lookups: the distance of x to the coded y is a sum over subspaces of table entries, and misses the true one
  by at most y's coding error, which is stored. Pairs beyond r plus that error are dropped.
* rerank: what remains is decided by the exact cosine in double precision.

So recall is 1 by construction; the quantisers, fitted on a bounded sample, only decide how much work is saved. A list
that is too long, or asked too often, for one task is cut into parts that each meet all parts of the other side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import join_classes, materialise, release
from tidemark.llm.vectors import k_means, squared_distances, usable, wide

THRESHOLD = 0.93
#: Vectors that the quantisers are fitted on, at most.
SAMPLE = 8192
#: Vectors of a list that a task holds at a time, and vectors that ask it there, at most on average.
HELD, ASKING = 8192, 32_768
#: What sums of table entries in single precision may miss, with room to spare: they are at most some tens.
SLACK = 1e-4
SUBSPACES, CODES = 8, 64
#: Vectors of the largest label for one coarse centroid, and centroids at most.
PER_CELL, MOST_CELLS = 2048, 1024


class Quantiser:
    """Coarse centroids and, for their residuals, a codebook in each subspace."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.width = sample.shape[1]
        self.coarse = k_means(sample, cells)
        rest = sample - self.coarse[squared_distances(sample, self.coarse).argmin(1)]
        self.cuts = np.linspace(0, self.width, min(SUBSPACES, self.width) + 1).astype(int)
        self.books = [k_means(rest[:, a:b], CODES, seed=i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))]
        self.between = np.sqrt(squared_distances(self.coarse, self.coarse))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """list, code in each subspace, coding error and distances (squared) to all centroids of each row."""
        far = squared_distances(x, self.coarse)
        cell = far.argmin(1)
        rest = x - self.coarse[cell]
        codes, error = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for i, book in enumerate(self.books):
            part = rest[:, self.cuts[i] : self.cuts[i + 1]]
            codes[:, i] = squared_distances(part, book).argmin(1)
            error += ((part - book[codes[:, i]]) ** 2).sum(1)
        return cell, codes, np.sqrt(error), far

    def probes(self, cell: np.ndarray, far: np.ndarray, reach: float) -> np.ndarray:
        """Which lists each row must ask: its own, and those after it that the plane between cannot exclude."""
        own = far[np.arange(len(far)), cell]
        within = far - own[:, None] <= 2 * reach * self.between[cell] + 1e-9
        return (within & (np.arange(far.shape[1])[None, :] > cell[:, None])) | (np.arange(far.shape[1])[None, :] == cell[:, None])

    def lookups(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of the rows of x to the coded vectors of a list, summed from tables in single precision.

        A table has a row for each code, so that a coded vector's entries for all rows of x lie side by side.
        """
        rest = x - self.coarse[cell]
        total = np.zeros((len(codes), len(x)), np.float32)
        for i, book in enumerate(self.books):
            table = squared_distances(book, rest[:, self.cuts[i] : self.cuts[i + 1]]).astype(np.float32)
            total += table[codes[:, i]]
        return total.T


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by their largest component (against overflow), and of length one."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(blobs: list[bytes], width: int) -> np.ndarray:
    """Rows of a matrix from their bytes, in single or double precision each."""
    kinds = {4 * width: np.float32, 8 * width: np.float64}
    if len({len(b) for b in blobs}) == 1:
        return np.frombuffer(b"".join(blobs), kinds[len(blobs[0])]).reshape(-1, width).astype(np.float64)
    return np.stack([np.frombuffer(b, kinds[len(b)]).astype(np.float64) for b in blobs])


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) that join what the links a-b join."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


class Held:
    """The vectors of one part of a list that a task holds, and the links that others find among them."""

    def __init__(self, cell: int, width: int, quantiser: Quantiser, threshold: float) -> None:
        self.cell, self.width, self.quantiser, self.threshold = cell, width, quantiser, threshold
        self.reach = math.sqrt(2 - 2 * threshold) + 1e-7
        self.parts: list[tuple] = []

    def add(self, *columns: np.ndarray) -> None:
        """node, size, vectors, codes, error."""
        self.parts.append(columns)

    def ask(self, node: np.ndarray, size: np.ndarray, raw: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray] | None:
        """Links of the asking vectors; those whose `own` list this is meet each other once."""
        if not self.parts:
            return None
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(c) for c in zip(*self.parts, strict=True))]
        nodes, sizes, vectors, codes, error = self.parts[0]
        x, unit_x = _unit(raw)
        y, _ = _unit(vectors)
        norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        left, right = [], []
        padded = np.zeros((len(unit_x), self.quantiser.width))
        padded[:, : self.width] = unit_x
        unit_y, most = y / norm_y[:, None], ((self.reach + error + 1e-6) ** 2 + SLACK).astype(np.float32)[None, :]
        for at in range(0, len(x), 512):
            near = self.quantiser.lookups(padded[at : at + 512], self.cell, codes) <= most
            if own[at : at + 512].any():
                near &= ~own[at : at + 512, None] | (node[at : at + 512, None] < nodes[None, :])
            if np.count_nonzero(near) > len(near):  # many are left: a product of the block leaves those that may reach it
                near &= unit_x[at : at + 512] @ unit_y.T >= self.threshold - 1e-9
            i, j = np.nonzero(near)
            i += at
            for part in range(0, len(i), 1 << 16):
                p, q = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                close = (x[p] * y[q]).sum(1) / (norm_x[p] * norm_y[q]) >= self.threshold
                left.append(p[close])
                right.append(q[close])
        if not any(map(len, left)):
            return None
        i, j = np.concatenate(left), np.concatenate(right)
        gain_x, gain_y = np.bincount(i, sizes[j], len(node)), np.bincount(j, size[i], len(nodes))
        src, dst = _star(node[i], nodes[j])
        gained = (gain_x > 0).sum() + (gain_y > 0).sum()
        return {"node": np.concatenate([node[gain_x > 0], nodes[gain_y > 0], src]), "gain": np.concatenate([gain_x[gain_x > 0], gain_y[gain_y > 0], np.zeros(len(src))]), "other": np.concatenate([np.full(gained, -1), dst])}


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding, label; others are ignored).

    Rows link when their labels are equal and not null, their vectors have the same width and the cosine is at least
    `threshold`. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    neither do rows with a null label: n_links 0, component_id their own vec_id. Equal vectors of a label are one node
    with a count, however many there are; rows that repeat a vec_id are rows of their own. A null vec_id names no
    component unless all of it have none, and is not kept. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    vector = F.transform("embedding", lambda x: x.cast("double"))
    able = F.col("label").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    rows = rows.select("vec_id", "label", vector.alias("embedding"), F.coalesce(able, F.lit(False)).alias("able"))
    keyed = rows.where("able").select("vec_id", "label", "embedding", F.xxhash64("label", "embedding").alias("h1"), F.xxhash64("embedding", F.lit("second"), "label").alias("h2"))
    classes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = materialise(classes.select("*", F.size("embedding").alias("width"), F.monotonically_increasing_id().alias("node")), "vector_classes")
    links = _links(classes, threshold)
    gains = links.groupBy("node").agg(F.sum("gain").alias("gain"))
    groups = connected_components(links.where("other >= 0").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    named = classes.select("node", "h1", "h2", "least", "size").join(groups, "node", "left").join(gains, "node", "left")
    named = named.select("h1", "h2", "least", "size", (F.col("size") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    found = join_classes(keyed.select("vec_id", "h1", "h2"), named.join(least, "group").select("h1", "h2", "size", "n_links", "component_id"), ["h1", "h2"])
    alone = rows.where("not able").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """node, gain, other: rows that a node gains by links (other -1), and links that span groups (gain 0)."""
    facts = classes.agg(F.max("width").alias("width")).first()
    width = facts["width"] or 1
    largest = classes.groupBy("label", "width").count().agg(F.max("count")).first()[0] or 0
    sample = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding").collect()
    fitted = _unit(wide([r["embedding"] for r in sample], width))[1] if sample else np.ones((1, width))
    quantiser, reach = Quantiser(fitted, min(MOST_CELLS, max(1, largest // PER_CELL))), math.sqrt(2 - 2 * threshold) + 1e-7

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding").to_pylist()
            cell, codes, error, far = quantiser.encode(_unit(wide(vectors, width))[1])
            probes = quantiser.probes(cell, far, reach)
            raw = [np.array(v, np.float64) for v in vectors]
            # Most tables hold single precision: where that is all a vector has, half the bytes say the same.
            blobs = [f.tobytes() if (f := v.astype(np.float32)).astype(np.float64).tobytes() == v.tobytes() else v.tobytes() for v in raw]
            columns = [*(b.column(c) for c in ("label", "width", "node", "size")), pa.array(cell.astype(np.int32)), pa.array([np.flatnonzero(p).tolist() for p in probes], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["label", "width", "node", "size", "cell", "probes", "vector", "codes", "error"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in (*group, "role")), strict=True))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                *mine, role = keys[at]
                if mine != key:
                    key, held = mine, Held(mine[2], mine[1], quantiser, threshold)
                rows = b.slice(at, end - at)
                node, size = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "size"))
                raw = _vectors(rows.column("vector").to_pylist(), mine[1])
                if not role:
                    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(node), -1)
                    held.add(node, size, raw, codes, rows.column("error").to_numpy(zero_copy_only=False))
                elif found := held.ask(node, size, raw, rows.column("own").to_numpy(zero_copy_only=False).astype(bool)):
                    yield pa.RecordBatch.from_arrays([pa.array(found[c].astype(np.int64)) for c in ("node", "gain", "other")], names=["node", "gain", "other"])
                at = end

    group = ("label", "width", "cell", "sub", "part")
    rows = classes.select(F.col("label").cast("string").alias("label"), "width", "node", "size", "embedding")
    coded = materialise(rows.mapInArrow(code, "label string, width int, node bigint, size bigint, cell int, probes array<int>, vector binary, codes binary, error double"), "vector_codes")
    lists = ["label", "width", "cell"]
    asked = coded.select("label", "width", F.explode("probes").alias("cell"), (F.col("cell")).alias("home"), "node", "size", "vector")
    counts = coded.groupBy(*lists).agg(F.count("*").alias("held")).join(asked.groupBy(*lists).agg(F.count("*").alias("asking")), lists)
    # Only lists too long or asked too often: at most one for each HELD vectors or ASKING probes.
    long = F.broadcast(counts.select(*lists, F.ceil(F.col("held") / HELD).cast("int").alias("subs"), F.ceil(F.col("asking") / ASKING).cast("int").alias("parts")).where("subs > 1 or parts > 1"))
    subs, parts = F.coalesce("subs", F.lit(1)), F.coalesce("parts", F.lit(1))
    holding = coded.join(long, lists, "left").select(
        *lists, F.pmod(F.xxhash64("node"), subs).cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("role"), "node", "size", "vector", "codes", "error", F.lit(True).alias("own")
    )
    asking = asked.join(long, lists, "left").select(
        *lists, F.explode(F.sequence(F.lit(0), subs - 1)).alias("sub"), F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int").alias("part"), F.lit(1).alias("role"), "node", "size", "vector",
        F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), (F.col("home") == F.col("cell")).alias("own"),
    )
    dealt = holding.unionByName(asking).repartition(*group).sortWithinPartitions(*group, "role")
    found = materialise(dealt.mapInArrow(compare, "node bigint, gain bigint, other bigint"), "vector_links")
    release(coded)
    return found


#: The same in DuckDB's dialect by comparing all pairs, for tables whose vec_ids are unique and that it can hold.
SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= {THRESHOLD}
), reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""
