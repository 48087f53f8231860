"""Operator 13: online packing by the sum-of-squares rule.

Documents become token ids and are placed one after another as they are read.
A window is a sequence that is not full yet; its level is how many tokens it
holds.  The level array counts the open windows of each level.  A document
goes to the level (or to a new window) that leaves the smallest sum of squared
counts, so no level gathers many windows and short rests stay rare.

A task packs the documents it reads, in one pass and without a shuffle; its
state is the level array and the open windows, whose tokens are bounded.  Full
windows are written at once.  Where the bound is met, and at a task's end, the
open windows' tokens are dealt anew into full ones, cutting documents at their
ends; the last tokens of a task make sequences of powers of two, which take
no padding.  So no sequence is padded, and few documents are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.tokens import encoder

CAPACITY = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Tokens in open windows that a task holds, four bytes each.
OPEN_TOKENS = 8_000_000

PACKED = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")

#: A part of a document: id, its first token's place, its document's tokens, ids.
Part = tuple[int | None, int, int, bytes]
_NONE = 1 << 60


class Levels:
    """Open windows by level, and what a change of their counts costs."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.windows: list[list[list[Part]]] = [[] for _ in range(capacity)]
        # the change of the sum of squares when a window comes to a level, or leaves it;
        # new and full windows are not counted
        self.come = np.ones(capacity + 1, np.int64)
        self.leave = np.full(capacity + 1, _NONE, np.int64)
        self.come[capacity] = self.leave[0] = 0
        self.tokens = 0

    def choose(self, size: int) -> int:
        """The level of the window that takes ``size`` tokens (0: a new one);
        of equally good ones the fullest."""
        change = self.leave[:self.capacity - size + 1] + self.come[size:]
        return self.capacity - size - int(change[::-1].argmin())

    def put(self, level: int, window: list[Part]) -> None:
        self.windows[level].append(window)
        self.tokens += level
        self._count(level)

    def take(self, level: int) -> list[Part]:
        if level == 0:
            return []
        window = self.windows[level].pop()
        self.tokens -= level
        self._count(level)
        return window

    def _count(self, level: int) -> None:
        n = len(self.windows[level])
        self.come[level] = 1 + 2 * n
        self.leave[level] = 1 - 2 * n if n else _NONE

    def place(self, part: Part) -> list[Part] | None:
        """Puts a part, smaller than the capacity, into a window.  The window, if that fills it."""
        size = len(part[3]) // 4
        level = self.choose(size)
        window = self.take(level)
        window.append(part)
        if level + size == self.capacity:
            return window
        self.put(level + size, window)
        return None

    def drain(self) -> list[list[Part]]:
        """All open windows, fullest first; none stays."""
        out = [w for level in range(self.capacity - 1, 0, -1) for w in self.windows[level]]
        self.__init__(self.capacity)
        return out


def cut_parts(parts: list[Part], sizes: Iterator[int]) -> Iterator[list[Part]]:
    """The parts' tokens in turn, cut into windows of the given sizes, as long
    as tokens are left; parts are cut at windows' ends only."""
    window: list[Part] = []
    room = next(sizes)
    for doc_id, start, tokens, ids in parts:
        while ids:
            head = ids[:4 * room]
            window.append((doc_id, start, tokens, head))
            n = len(head) // 4
            start, ids, room = start + n, ids[4 * n:], room - n
            if room == 0:
                yield window
                window, room = [], next(sizes, 0)
    if window:
        yield window


def powers(n: int) -> list[int]:
    """The powers of two that make up ``n``, largest first."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


class Packer:
    """One task's documents to windows that are done."""

    def __init__(self, capacity: int = CAPACITY, open_tokens: int = OPEN_TOKENS):
        self.levels, self.capacity, self.open_tokens = Levels(capacity), capacity, open_tokens

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Part]]:
        tokens = len(ids) // 4
        whole = tokens - tokens % self.capacity
        for at in range(0, whole, self.capacity):
            yield [(doc_id, at, tokens, ids[4 * at:4 * (at + self.capacity)])]
        if tokens > whole:
            window = self.levels.place((doc_id, whole, tokens, ids[4 * whole:]))
            if window:
                yield window
        if self.levels.tokens > self.open_tokens:
            yield from self._deal_anew(end=False)

    def end(self) -> Iterator[list[Part]]:
        yield from self._deal_anew(end=True)

    def _deal_anew(self, end: bool) -> Iterator[list[Part]]:
        """Full windows of what is open.  What is left stays open, or makes
        windows of powers of two."""
        n = self.levels.tokens
        full, rest = divmod(n, self.capacity)
        sizes = [self.capacity] * full + (powers(rest) if end else [rest] * bool(rest))
        parts = [p for w in self.levels.drain() for p in w]
        windows = cut_parts(parts, iter(sizes)) if parts else iter(())
        for i, window in enumerate(windows):
            if i < full or end:
                yield window
            else:
                self.levels.put(rest, window)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID,
         open_tokens: int = OPEN_TOKENS) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of ``capacity`` tokens, or of
    a power of two below it.

    Returns per piece doc_id, start (its document's tokens before it), length,
    ids_crc32, doc_tokens, sequence_id and offset.  Each document ends with
    ``end_id``, so null and empty texts are one token long; nothing is dropped
    or padded.  Repeated rows, and rows with a null id, are packed once each.
    An empty table gives an empty result; other columns are not looked at."""
    end = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in PACKED.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary), Packer(capacity, open_tokens)
        made = TaskContext.get().partitionId() << 40

        def rows(windows: Iterator[list[Part]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            cols: list[list] = [[] for _ in names]
            for window in windows:
                offset = 0
                for doc_id, start, tokens, ids in window:
                    n = len(ids) // 4
                    for col, value in zip(cols, (doc_id, start, n, zlib.crc32(ids), tokens, made, offset), strict=True):
                        col.append(value)
                    offset += n
                made += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(1))
            ids = zip(batch.column(0).to_pylist(), encode(texts), strict=True)
            yield from rows(w for doc_id, x in ids for w in packer.add(doc_id, x + end))
        yield from rows(packer.end())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(place, PACKED)
