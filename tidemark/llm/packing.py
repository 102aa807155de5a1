"""Packing token sequences by minimum bin slack.

Each document is tokenised once, in the task that reads it, and cut into whole windows of CAPACITY ids and a rest.
Whole windows are sequences of their own. The rests of a task are packed by minimum bin slack: the longest rest left
anchors a window, a subset-sum table over the multiset of remaining lengths (one Python integer as bit set, a state for
each power-of-two part of a length's count) finds the fill nearest to the capacity, and walking the states backwards
gives how many rests of each length make it. What slack is left beyond MAX_SLACK is filled by cutting one rest. The
last window of a task is cut at powers of two, which need no padding. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.shared import sliced, texts_of

CAPACITY = 2048
END_ID = 1
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Rests that wait in a task before windows are filled, and as many as stay for the next round (more lengths to choose from).
GROUP, STAY = 4096, 512
#: Ids of padding for the sake of which no document is cut.
MAX_SLACK = 8


class Bpe:
    """Byte-level BPE over whole texts; the special token's string in a text is the special token."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        ids = self.coder.encode(text, allowed_special="all") if SPECIAL in text else self.coder.encode_ordinary(text)
        return array("I", ids).tobytes()


_bpe: dict[str | None, Bpe] = {}


def bpe(path: str | None = None) -> Bpe:
    if path not in _bpe:
        _bpe[path] = Bpe(path)
    return _bpe[path]


def best_fill(counts: dict[int, int], need: int) -> dict[int, int]:
    """How many pieces of each length (at most its count) make the largest sum up to `need`; exact by subset sums."""
    reached, states, limit = 1, [], (1 << (need + 1)) - 1
    for length in sorted((x for x in counts if x <= need), reverse=True):
        left, part = min(counts[length], need // length), 1
        while left > 0 and not reached >> need & 1:
            take = min(part, left)
            states.append((length, take, reached))
            reached |= (reached << (length * take)) & limit
            left -= take
            part *= 2
        if reached >> need & 1:
            break
    total, used = reached.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(states):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return dict(used)


class Packer:
    """Windows from the rests of one task; a rest is [doc_id, start, ids, tokens of its document]."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.rests: dict[int, list] = defaultdict(list)
        self.waiting = 0

    def add(self, rest: list) -> None:
        self.rests[len(rest[2]) // 4].append(rest)
        self.waiting += 1

    def _take(self, length: int) -> list:
        rest = self.rests[length].pop()
        if not self.rests[length]:
            del self.rests[length]
        self.waiting -= 1
        return rest

    def _cut(self, size: int) -> list:
        """The first `size` ids of the longest rest; what is left of it waits again."""
        doc, start, ids, tokens = self._take(max(self.rests))
        self.add([doc, start + size, ids[4 * size :], tokens])
        return [doc, start, ids[: 4 * size], tokens]

    def windows(self, down_to: int) -> Iterator[list[list]]:
        """Full windows (up to MAX_SLACK) until `down_to` rests wait; with 0, all rests leave."""
        while self.waiting > down_to:
            if self.waiting < self.capacity and sum(k * len(v) for k, v in self.rests.items()) < self.capacity:
                if not down_to:
                    yield from self._powers()
                return
            anchor = max(self.rests)
            counts = {k: len(v) for k, v in self.rests.items()}
            counts[anchor] -= 1
            used = best_fill({k: n for k, n in counts.items() if n}, self.capacity - anchor)
            used[anchor] = used.get(anchor, 0) + 1
            slack = self.capacity - sum(k * n for k, n in used.items())
            for _ in range(min(len(self.rests[k]) // n for k, n in used.items()) if slack <= MAX_SLACK else 1):
                window = [self._take(k) for k, n in used.items() for _ in range(n)]
                if slack > MAX_SLACK and self.waiting:
                    window.append(self._cut(slack))
                yield window

    def _powers(self) -> Iterator[list[list]]:
        """All rests, together less than a window, in sequences whose lengths are powers of two."""
        while self.waiting:
            total = sum(k * len(v) for k, v in self.rests.items())
            room, window = 1 << (total.bit_length() - 1), []
            while room:
                longest = max(self.rests)
                piece = self._take(longest) if longest <= room else self._cut(room)
                window.append(piece)
                room -= len(piece[2]) // 4
            yield window


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each piece of the documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    `ids` (array<int>, left out unless `with_ids`) are the piece's token ids; start counts its document's ids before
    it; offset its place in the sequence. A document's ids are those of its text and END_ID, so null and empty texts
    give one id; texts of any length are cut. Pieces of a document never overlap or miss an id; repeated rows are packed one by one; null doc_ids
    stay null; an empty table gives no rows; further columns are ignored. A sequence_id is the reading task's number
    and a count, so a task that runs again on the same input gives the same rows. A task holds at most GROUP rests.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {kind}, " + ", ".join(f"`{n}` bigint" for n in names[1:]) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = bpe(tokenizer_path), Packer(capacity)
        sequence = TaskContext.get().partitionId() << 36
        end = array("I", [END_ID]).tobytes()
        rows: list[tuple] = []
        ids_out: list[bytes] = []
        size, id_type = 4 * capacity, pa.int64()

        def put(window: list[list]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, tokens in window:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset))
                offset += len(ids) // 4
                if with_ids:
                    ids_out.append(ids)
            sequence += 1

        def out() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in rows], id_type), *(pa.array(list(c), pa.int64()) for c in list(zip(*rows, strict=True))[1:])]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids_out), np.int32))))
            rows.clear()
            ids_out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*names, *["ids"] * with_ids])

        for batch in sliced(batches):
            id_type = batch.column("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = coder.encode(text) + end
                tokens = len(ids) // 4
                whole = len(ids) - len(ids) % size
                for at in range(0, whole, size):
                    put([[doc, at // 4, ids[at : at + size], tokens]])
                if whole < len(ids):
                    packer.add([doc, whole // 4, ids[whole:], tokens])
                if packer.waiting >= GROUP:
                    for window in packer.windows(STAY):
                        put(window)
                if len(rows) >= 1024:
                    yield out()
        for window in packer.windows(0):
            put(window)
        if rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
