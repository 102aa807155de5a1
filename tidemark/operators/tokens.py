"""Exact token counts by a byte-pair vocabulary.

Texts fall into pieces by the vocabulary's pattern, in the JVM. Each different piece is merged once, however often it
occurs, in a table of its own, so the merging costs what the vocabulary of the corpus costs and not the corpus. Sums over
a corpus are sums over that table. Counts by text join it back: the pieces that occur most are sent to the tasks, and the
few occurrences of others are merged where they stand, so no text and none of its pieces is ever shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.tables import materialise

# Fixed value: the pattern that splits texts before the merges of byte-level rank files. White space is Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: Pieces whose counts are sent to all tasks: the most frequent ones of at most so many characters.
FREQUENT, FREQUENT_LENGTH = 100_000, 64
#: Other pieces whose counts a task remembers.
REMEMBERED = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file, a base64 token and its rank a line; the driver reads it and it goes with the tasks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Into how many tokens byte-pair merging takes a piece: the pair of least rank first, the leftmost of equal ones.

    Adjacent pairs wait in a heap; a merge changes its two neighbours alone, so long pieces cost n log n.
    """
    n = len(piece)
    end, before, gone, left = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n), n
    pairs = [(ranks[piece[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapify(pairs)

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heappush(pairs, (rank, i, j, end[j]))

    while pairs:
        _, i, j, k = heappop(pairs)
        if gone[i] or gone[j] or end[i] != j or end[j] != k:
            continue
        end[i], gone[j], left = k, 1, left - 1
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return left


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def piece_tokens(texts: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """piece, n, tokens: every different piece of the whole texts, its occurrences and its number of tokens; written once."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [merged_length(p.encode(), ranks) for p in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], names=[*b.schema.names, "tokens"])

    counted = texts.select(F.explode(pieces(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    return materialise(counted.mapInArrow(merge, "piece string, n bigint, tokens bigint"), "piece_tokens")


def exact_token_counts(texts: DataFrame, ranks: dict[bytes, int], name: str = "tokens") -> DataFrame:
    """`texts` (with a column text) and, as column `name`, the number of tokens of each whole text; NULL and empty texts have none.

    Special tokens' strings are ordinary text. Rows that repeat a text are counted each, other columns may have any
    name; an empty table stays empty. ValueError if there is a column `name` already.
    """
    if name in texts.columns:
        raise ValueError(f"there is a column {name!r} already")
    table = piece_tokens(texts, ranks)
    level = F.floor(4 * F.log2("n")).cast("int")  # counts within a fifth of one another
    short = table.where(F.char_length("piece") <= FREQUENT_LENGTH).withColumn("level", level)
    least, held = 0, 0
    for r in sorted(short.groupBy("level").count().collect(), reverse=True):
        if (held := held + r["count"]) > FREQUENT:
            least = r["level"] + 1
            break
    often = short.where(F.col("level") >= least)  # FREQUENT rows at most, chosen without a sort
    names = [*texts.columns, name]
    known = {r["piece"]: r["tokens"] for r in often.select("piece", "tokens").collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def other(piece: str) -> int:
            if (n := seen.get(piece)) is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                n = seen[piece] = merged_length(piece.encode(), ranks)
            return n

        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                totals = [sum(n if (n := known.get(p)) is not None else other(p) for p in row or ()) for row in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(totals, pa.int64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields) + f", `{name}` bigint"
    return texts.select("*", pieces(F.col("text")).alias("__pieces")).mapInArrow(count, schema)


def exact_corpus_tokens(texts: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """documents, pieces, different_pieces, tokens of all texts: the table of pieces alone is summed, nothing is joined."""
    sums = piece_tokens(texts, ranks).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.count("*").alias("different_pieces"), F.coalesce(F.sum(F.col("n") * F.col("tokens")), F.lit(0)).alias("tokens"))
    return texts.agg(F.count("*").alias("documents")).crossJoin(sums)  # one row and one row
