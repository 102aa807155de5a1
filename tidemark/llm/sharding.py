"""Sharding by k-d tree partitioning, in DataFrame operations alone.

The rows are split recursively at weighted medians (or, where the number of leaves below is odd, the matching share)
along the widest metadata dimension, until each leaf is a shard of the target bytes. The dimensions are metadata of the
text alone, so equal texts lie at one point.

Reading for every split anew is spared by a summary: the bytes of each cell of a grid over all dimensions (at most
GRID cells a dimension, by quantiles). The whole tree is laid out over the summary on the driver, which gives each split
its dimension and a narrow bracket. Then one grouped histogram a level, for all its nodes at once, finds the splits
within their brackets; only where a bin still weighs too much is it read again, more finely.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise

SHARDS = 24
OVERHEAD = 8
#: Bins of a histogram of a split, and cells of the summary along a dimension: what reaches the driver.
BINS, GRID = 8192, 32
#: Rows of a bin whose keys are told one by one where the bin weighs too much.
EXACT = 20_000
#: Part of all bytes by which a split may miss its share.
TOLERANCE = 1e-4
#: Part of a shard's target that a group of equal texts may weigh and still go whole to one side of a split.
HEAVY = 0.02
#: Rows of a reading task that get their places in shards together.
CHUNK_BITS = 12
#: Each dimension's sort key is its value and then the text's hash, so that equal texts are neighbours in all.
DIMENSIONS = ("size_key", "beyond_key", "text_key")
SALTS = (1 << 62) - 1
ABOVE = 1 << 62


@dataclass
class Node:
    leaves: int
    first: int
    left: Node | None = None
    right: Node | None = None
    key: str = ""
    at: int = 0
    salt: int = 0

    def column(self) -> Column:
        """The number of the leaf (or node without a split so far) that a row is in."""
        if self.left is None:
            return F.lit(self.first)
        below = F.col(self.key) < self.at
        if self.salt:
            below |= (F.col(self.key) == self.at) & (F.col("salt") < self.salt)
        return F.when(below, self.left.column()).otherwise(self.right.column())


@dataclass
class Search:
    """Where the split of a node may lie: keys from low to high, in bins or one by one (`exact`).

    `tie` is the one key whose rows are parted by salt; low and high are salts then.
    """

    node: Node
    key: str
    low: int
    high: int
    exact: bool = False
    tie: int | None = None

    @property
    def width(self) -> int:
        return (self.high - self.low) // BINS + 1


def row_sizes(docs: DataFrame) -> DataFrame:
    """A compact table of doc_id, size, text_crc32, row (unique), the dimensions' keys and a salt, written once.

    Size is in steps of a 16th of a power of two, `beyond` the share of bytes beyond one a character in 256ths: how far
    a text is from plain ASCII, which tells scripts and languages apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("bigint")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.char_length(text).alias("chars"), F.shiftrightunsigned(F.xxhash64(text), 16).alias("hash"), F.monotonically_increasing_id().alias("row"))
    steps = F.floor(F.log2("size") * 16).cast("bigint")
    beyond = F.floor((F.col("size") - OVERHEAD - F.col("chars")) * 255 / F.greatest(F.col("size") - OVERHEAD, F.lit(1))).cast("bigint")
    keyed = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        "row",
        F.shiftleft(steps, 48).bitwiseOR(F.col("hash")).alias("size_key"),
        F.shiftleft(beyond, 48).bitwiseOR(F.col("hash")).alias("beyond_key"),
        F.col("hash").alias("text_key"),
        F.shiftrightunsigned(F.xxhash64("row"), 2).alias("salt"),
    )
    return materialise(keyed, "shard_rows")


def _summary(rows: DataFrame) -> tuple[dict[str, list[int]], dict[tuple[int, ...], int]]:
    """The edges of the grid's cells by dimension (first: the least key, last: the greatest), and the bytes of each cell."""
    shares = [i / GRID for i in range(GRID + 1)]
    found = rows.agg(*(F.percentile_approx(d, F.array(*map(F.lit, shares)), F.lit(2000)).alias(d) for d in DIMENSIONS)).first()
    edges = {d: sorted(set(found[d] or [])) for d in DIMENSIONS}
    cell = [sum((F.col(d) >= e).cast("int") for e in edges[d][1:-1]) if len(edges[d]) > 2 else F.lit(0) for d in DIMENSIONS]
    cells = rows.groupBy(*(c.alias(f"cell_{d}") for c, d in zip(cell, DIMENSIONS, strict=True))).agg(F.sum("size").alias("bytes")).collect()
    return edges, {tuple(r)[:-1]: r["bytes"] for r in cells}


def _layout(node: Node, cells: dict[tuple[int, ...], int], edges: dict[str, list[int]], searches: dict[int, Search], at: int = 1) -> None:
    """Splits `node` down to its leaves over the cells; `searches` gets a bracket for each split, by heap position."""
    if node.leaves == 1:
        return
    half, total = node.leaves // 2, sum(cells.values())
    node.left, node.right = Node(half, node.first), Node(node.leaves - half, node.first + half)

    def extent(i: int) -> tuple[int, int, int]:
        d, held = DIMENSIONS[i], [c[i] for c in cells]
        low, high = edges[d][min(held)], edges[d][min(max(held) + 1, len(edges[d]) - 1)]
        return low, high, edges[d][-1] - edges[d][0]

    extents = [extent(i) for i in range(len(DIMENSIONS))] if cells else [(0, 0, 1)] * len(DIMENSIONS)
    widest = max(range(len(DIMENSIONS)), key=lambda i: (extents[i][1] - extents[i][0]) / max(extents[i][2], 1))
    key, marks = DIMENSIONS[widest], edges[DIMENSIONS[widest]]
    by: dict[int, int] = {}
    for c, n in cells.items():
        by[c[widest]] = by.get(c[widest], 0) + n
    below, split = 0, 0
    for c in sorted(by):
        split = c
        if below + by[c] > total * half / node.leaves:
            break
        below += by[c]
    if cells:
        low, high = marks[max(split - 2, 0)], marks[min(split + 3, len(marks) - 1)]
        node.key, node.at = key, marks[split]
        searches[at] = Search(node, key, low, high)
    else:
        node.key = key
    _layout(node.left, {c: n for c, n in cells.items() if c[widest] < split}, edges, searches, 2 * at)
    _layout(node.right, {c: n for c, n in cells.items() if c[widest] >= split}, edges, searches, 2 * at + 1)


def kd_tree(rows: DataFrame, shards: int = SHARDS) -> Node:
    """The tree over `rows` (see row_sizes) whose leaves, from left to right, are the shards."""
    edges, cells = _summary(rows)
    root, searches = Node(shards, 0), {}
    _layout(root, cells, edges, searches)
    whole, level = sum(cells.values()), 1
    while todo := [s for at, s in searches.items() if at.bit_length() == level]:
        number = _numbering(root, level)
        while todo:
            todo = _narrow(rows, number, todo, whole * TOLERANCE, whole / shards * HEAVY)
        level += 1
    return root


def _numbering(node: Node, level: int) -> Column:
    """Which node of a level a row is in, by its first leaf; leaves above the level keep their own."""
    if level == 1 or node.left is None:
        return F.lit(node.first)
    below = F.col(node.key) < node.at
    if node.salt:
        below |= (F.col(node.key) == node.at) & (F.col("salt") < node.salt)
    return F.when(below, _numbering(node.left, level - 1)).otherwise(_numbering(node.right, level - 1))


def _narrow(rows: DataFrame, number: Column, searches: list[Search], tolerance: float, heavy: float) -> list[Search]:
    """One histogram for all searches; sets the splits that are found and gives the searches that go on."""
    place = key = None
    for s in searches:
        value = F.col(s.key if s.tie is None else "salt")
        inside = value if s.exact else F.expr(f"({s.key if s.tie is None else 'salt'} - {s.low}L) div {s.width}L")
        bin_ = F.when(value < s.low, -1).when(value > s.high, ABOVE).otherwise(inside)
        if s.tie is not None:
            bin_ = F.when(F.col(s.key) < s.tie, -1).when(F.col(s.key) > s.tie, ABOVE).otherwise(bin_)
        mine = F.col("node") == s.node.first
        place, key = (F.when(mine, bin_), F.when(mine, value)) if place is None else (place.when(mine, bin_), key.when(mine, value))
    bins = rows.select(number.alias("node"), "size", *DIMENSIONS, "salt").select("node", "size", place.cast("bigint").alias("bin"), key.alias("value")).where("bin is not null")
    weights: dict[int, dict[int, tuple]] = {}
    for r in bins.groupBy("node", "bin").agg(F.sum("size"), F.count("*"), F.min("value"), F.max("value")).collect():
        weights.setdefault(r["node"], {})[r["bin"]] = tuple(r)[2:]
    return [s for s in searches if not _settle(s, weights.get(s.node.first, {}), tolerance, heavy)]


def _settle(s: Search, weights: dict[int, tuple], tolerance: float, heavy: float) -> bool:
    """Sets the split of a search from the bytes, rows, least and greatest keys of its bins, or gives it a new bracket."""
    want = sum(w[0] for w in weights.values()) * (s.node.leaves // 2) / s.node.leaves
    below, chosen = 0, None
    for b in sorted(weights):
        chosen = b
        if below + weights[b][0] > want:
            break
        below += weights[b][0]
    if chosen is None:
        return True
    size, n, low, high = weights[chosen]
    if chosen in (-1, ABOVE) and s.tie is None:  # the summary's bracket missed it: look at everything on that side
        s.low, s.high, s.exact = low, high, n <= EXACT
        return False
    if size <= tolerance or n == 1 or low == high and (s.tie is not None or size <= heavy):
        edge = low if want - below <= size / 2 else high + 1
        s.node.at, s.node.salt = (edge, 0) if s.tie is None else (s.tie, min(edge, SALTS))
        return True
    if low == high:  # one text that is copied too often to go to one side
        s.tie, s.low, s.high, s.exact = low, 0, SALTS, False
    else:
        s.low, s.high, s.exact = low, high, n <= EXACT
    return False


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs` (doc_id, text).

    The law is `bytes`: the shards' sums of size are near equal (within TOLERANCE of all bytes a split and one group).
    Equal texts have equal keys in every dimension, so they share a shard, whatever their other columns say; only a
    group that weighs more than HEAVY of a shard, and lies where a split must fall, is dealt out by a salt. slot
    counts from 0 in each shard, in the order of reading. Whole texts of any length are weighed. Null texts weigh OVERHEAD, as empty ones do, and are equal to
    them; repeated rows are rows; an empty table gives no rows; further columns are ignored. grown_shard is null.
    """
    rows = row_sizes(docs)
    tree = kd_tree(rows, shards)
    placed = rows.select("doc_id", "size", "text_crc32", "row", tree.column().alias("shard"), F.shiftright("row", CHUNK_BITS).alias("chunk"))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "chunk", before.alias("start"))
    rank = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("row"))
    return placed.join(starts, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + rank - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
