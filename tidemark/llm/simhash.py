"""SimHash near-duplicates: fingerprints linked through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of the perfect binary Golay code
[23, 12, 7] with leading zeros; decoding gives the index of the only codeword within three bits. A word one bit away
decodes to one of a few nearby indices: its own, or one of about five others. Fingerprints that differ in at most three
bits spread their errors over the segments, by the pigeonhole principle, in one of three ways:

* two segments have none: a key for each pair of segments, of both codeword indices and error patterns.
* one has none and another exactly one: a key of the first segment's index and pattern and of the other's nearby indices.
* each has exactly one: a key of the nearby indices of two segments.

Where a segment has exactly one error the parities of its two words differ, so the even one files itself under its own
index and the odd one looks under its nearby indices: the two meet, and each pair meets from one side alone.

So no link is lost, and a key holds 27 to 43 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import join_classes, materialise, scratch, sliced, texts_of

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Rows of one key that a task compares with each other at once; a larger bucket is cut into blocks, all pairs of which are compared.
BLOCK = 1024
#: Words of 64 rows, with a bit for each row that deduplicate drops, that are sent to all tasks at most: some 100 MB.
DROPPED_WORDS = 2_000_000
#: Bits of the segments, from the lowest.
SEGMENTS = (22, 21, 21)


def fingerprint(text: str) -> int:
    """The SimHash of a whole text as an unsigned 64-bit number; a text without words has 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """`docs` with its text column replaced by the signed 64-bit fingerprint of the text; other columns pass through."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f"{', ' if kept else ''}`{column}` bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(values)], names=[*(f.name for f in kept), column])

    return docs.mapInArrow(run, schema)


class Golay:
    """Decoder of the cyclic [23, 12, 7] code; its tables follow from the generator polynomial."""

    GENERATOR = 0b110001110101

    def __init__(self) -> None:
        self.rest = np.array([self._remainder(m << 11) for m in range(1 << 12)], np.int32)
        self.pattern = np.zeros(1 << 11, np.int32)
        single = [1 << i for i in range(23)]
        for i, a in enumerate(single):
            for j, b in enumerate([0, *single[:i]]):
                for c in [0, *single[: max(j - 1, 0)]]:
                    self.pattern[self.syndrome(np.array(a | b | c))] = a | b | c

    @classmethod
    def _remainder(cls, word: int) -> int:
        while word.bit_length() > 11:
            word ^= cls.GENERATOR << (word.bit_length() - 12)
        return word

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.rest[words >> 11] ^ (words & 0x7FF)

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the codeword next to each 23-bit word."""
        return (words ^ self.pattern[self.syndrome(words)]) >> 11


_golay: Golay | None = None


def golay() -> Golay:
    global _golay
    if _golay is None:
        _golay = Golay()
    return _golay


def _nearby(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The indices that the words decode to after a flip of any one bit, sorted, and which of them are new in their row."""
    found = np.sort(golay().index(segment[:, None] ^ (1 << np.arange(bits))[None, :]), axis=1)
    return found, np.concatenate([np.ones((len(segment), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of an array of unsigned fingerprints: (position in the array, key). See the module's text."""
    code, everyone = golay(), np.arange(len(prints))
    offsets = np.cumsum((0, *SEGMENTS))
    segment = [((prints >> np.uint64(offsets[s])) & np.uint64((1 << SEGMENTS[s]) - 1)).astype(np.int64) for s in range(3)]
    index = [code.index(x) for x in segment]
    exact = [(i << 11) | code.syndrome(x) for i, x in zip(index, segment, strict=True)]
    odd = [np.bitwise_count(x) & 1 == 1 for x in segment]
    near = [_nearby(x, n) for x, n in zip(segment, SEGMENTS, strict=True)]
    rows, keys = [], []

    def add(family: int, who: np.ndarray, key: np.ndarray) -> None:
        rows.append(who)
        keys.append((family << 58) | key)

    pairs = [(s, t) for s in range(3) for t in range(3) if s != t]
    for family, (s, t) in enumerate(p for p in pairs if p[0] < p[1]):
        add(family, everyone, (exact[s] << 23) | exact[t])
    for place, (s, t) in enumerate(pairs):
        even = np.flatnonzero(~odd[t])
        add(3, even, (place << 36) | (exact[s][even] << 12) | index[t][even])
        who = np.flatnonzero(odd[t])
        i, a = np.nonzero(near[t][1][who])
        add(3, who[i], (place << 36) | (exact[s][who[i]] << 12) | near[t][0][who[i], a])
    signs = (odd[1].astype(np.int64) << 1) | odd[2]
    even = np.flatnonzero(~odd[0])
    add(4, even, (index[0][even] << 14) | (index[1][even] << 2) | signs[even])
    who = np.flatnonzero(odd[0])
    i, a, b = np.nonzero(near[0][1][who][:, :, None] & near[1][1][who][:, None, :])
    i = who[i]
    add(4, i, (near[0][0][i, a] << 14) | (near[1][0][i, b] << 2) | (3 - signs[i]))
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def _keys_in_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = batch.column("fingerprint").to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(signed), 8_000):
            part = signed[at : at + 8_000]
            rows, keys = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fingerprint"])


class Forest:
    """Union-find over the fingerprints of one task; tells which links join two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def joins(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _links_within(run: np.ndarray, value: np.ndarray, forest: Forest) -> pa.RecordBatch:
    """Links between the fingerprints of each stretch of equal rows of `run` that span what is linked."""
    found, prints = [], value.view(np.uint64)
    start = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]).any(axis=1)]))
    length = np.diff(np.concatenate([start, [len(value)]]))
    place = np.arange(len(value)) - np.repeat(start, length)
    ahead = np.repeat(length, length) - place - 1
    alive, step = np.flatnonzero(ahead > 0), 1
    while len(alive):
        close = alive[np.bitwise_count(prints[alive] ^ prints[alive + step]) <= MAX_BITS]
        if len(close):
            found.append(np.stack([value[close], value[close + step]], axis=1))
        step += 1
        alive = alive[ahead[alive] >= step]
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    kept = [(a, b) for a, b in pairs.tolist() if a != b and forest.joins(a, b)]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], pa.int64()) for i in (0, 1)], names=["src", "dst"])


def _verified_links(names: tuple[str, ...], most: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that compares the fingerprints of each run of equal `names` (sorted) and gives links that span what is linked.

    With `most`, a run of more rows is not held: it comes out as one row whose src is null and whose dst is its first name.
    """

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        run, value = np.empty((0, len(names)), np.int64), np.empty(0, np.int64)

        def closed(run: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
            if most is not None:
                start = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]).any(axis=1)]))
                length = np.diff(np.concatenate([start, [len(value)]]))
                hot = length > most
                if hot.any():
                    yield pa.RecordBatch.from_arrays([pa.nulls(int(hot.sum()), pa.int64()), pa.array(run[start[hot], 0])], names=["src", "dst"])
                    few = ~np.repeat(hot, length)
                    run, value = run[few], value[few]
            if len(value):
                yield _links_within(run, value, forest)

        for batch in batches:
            if not batch.num_rows:
                continue
            run = np.concatenate([run, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)])
            value = np.concatenate([value, batch.column("fingerprint").to_numpy(zero_copy_only=False).astype(np.int64)])
            last = np.flatnonzero((run != run[-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from closed(run[:cut], value[:cut])
            run, value = run[cut:], value[cut:]
            if most is not None and len(value) > most + 1:  # it is hot already, whatever follows
                run, value = run[: most + 1], value[: most + 1]
        if len(value):
            yield from closed(run, value)

    return run_over


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (src, dst) between the distinct fingerprints of `prints` that span each group within MAX_BITS bits.

    Keys are made and dealt out once; a task reads its keys in order and compares what shares one. A key of more than
    BLOCK fingerprints is not held: it is named, and a second round cuts such keys into blocks, every pair of which is a
    group of its own, so no task holds more than two blocks of one key. Verified links leave a task only where they join
    two groups there.
    """
    keys = prints.select("fingerprint").mapInArrow(_keys_in_arrow, "key bigint, fingerprint bigint")
    found = materialise(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_verified_links(("key",), BLOCK), "src bigint, dst bigint"), "links")
    hot = found.where("src is null").select(F.col("dst").alias("key"))
    links = found.where("src is not null")
    if not hot.head(1):
        return links
    crowded = keys.join(hot, "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fingerprint"), blocks.cast("bigint")).cast("int")
    pairs = (
        crowded.join(crowded.groupBy("key").agg(F.count("*").alias("n")), "key")
        .select("key", "fingerprint", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("key", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"), "fingerprint")
    )
    dealt = pairs.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second")
    return links.unionByName(dealt.mapInArrow(_verified_links(("key", "first", "second")), "src bigint, dst bigint"))


def near_duplicate_groups(prints: DataFrame) -> DataFrame:
    """Rows (fingerprint, group, component_id, size) for the distinct fingerprints of `prints` (doc_id, fingerprint).

    group is the group's smallest fingerprint, component_id its smallest doc_id (null where it has null doc_ids only), size the fingerprint's number of rows.
    Equal fingerprints are one node, so exact copies cost one row however many there are.
    """
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size")), "fingerprints")
    groups = connected_components(fingerprint_links(nodes)).withColumnRenamed("node", "fingerprint")
    nodes = nodes.join(groups, "fingerprint", "left").select("fingerprint", "doc_id", "size", F.coalesce("component", "fingerprint").alias("component"))
    smallest = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return nodes.join(smallest, "component").select("fingerprint", F.col("component").alias("group"), "component_id", "size")


def simhash_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (bigint) and component_id for every row of `docs` (doc_id, text; other columns are ignored).

    Whole texts of any length are read. Null and blank texts have fingerprint 0 and are linked like any other; repeated
    rows each get a row; an empty table gives an empty result; a null doc_id stays null and never names a group that has another id.
    """
    prints = materialise(with_fingerprints(docs.select("doc_id", "text")), "doc_fingerprints")
    return join_classes(prints, near_duplicate_groups(prints), ["fingerprint"]).select("doc_id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each near-duplicate group, with all columns: the one with the smallest doc_id.

    Rows are numbered as they are written once to the shared folder; groups are decided on numbers, ids and fingerprints
    alone. What goes is gathered as a bit for each row, 64 rows to a word; while those words are few (DROPPED_WORDS,
    counted) they are sent to all tasks and no text is shuffled, beyond that rows and words meet by number. Whole texts of
    any length are read. Null and
    blank texts are one group; a null doc_id comes after all others; of rows that repeat a doc_id in a group the first
    read stays; an empty table stays empty; columns may have any name.
    """
    spark, columns = docs.sparkSession, [F.col(f"`{c}`") for c in docs.columns]
    rows = materialise(docs.select(F.struct(*columns).alias("row"), F.monotonically_increasing_id().alias("at")), "numbered_docs")
    with scratch(spark):
        prints = materialise(with_fingerprints(rows.select("at", "row.doc_id", "row.text")), "doc_fingerprints")
        groups = near_duplicate_groups(prints)
        marked = materialise(join_classes(prints, groups.select("fingerprint", "group", "size"), ["fingerprint"]).select("at", "doc_id", "group"), "grouped_docs")
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
        kept = marked.groupBy("group").agg(F.min(order).alias("kept")).select(F.col("kept.at").alias("at"))
        gone = marked.select("at").join(kept, "at", "left_anti")
        words = materialise(gone.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")), "dropped_docs", outer=True)
    small = F.broadcast(words) if words.count() <= DROPPED_WORDS else words
    left = rows.withColumn("word", F.shiftright("at", 6)).join(small, "word", "left")
    stays = F.expr("bits is null or (shiftrightunsigned(bits, cast(at & 63 as int)) & 1L) = 0")
    return left.where(stays).select("row.*")
