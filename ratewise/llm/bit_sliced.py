"""Operator 7: exact top-k search with a bit-sliced index.

Components become integers.  A block of rows stores, per component, one bitmap
for every bit of the component above the ``dropped`` lowest: the slices of a
quantised attribute.  A query weighs slices by its own integers and adds them
with bitmap arithmetic (carry-save adders over whole bitmaps), which gives the
slices of all rows' quantised scores at once.  From the most significant slice
downward these yield the k-th highest quantised score; every row that its
dropped bits could lift to it is a boundary row, and boundary rows are resolved
by their exact scores.  The bound holds for every row, so the result is exact.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from ratewise.llm import vector_blocks as vb

#: Low bits that the index leaves out.
DROPPED = 2
#: Queries whose bitmaps are added together.
BATCH = 128

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantise(vectors: np.ndarray, scale: float = 256.0) -> np.ndarray:
    return np.floor(scale * vectors).astype(np.int64)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them all."""
    low, high = values.min(initial=0), values.max(initial=0)
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


class Adder:
    """Sum of bitmaps given by bit position.  Three of a position become their
    sum there and a carry one position up as soon as they are there, so that a
    position holds two at most."""

    def __init__(self) -> None:
        self.columns: dict[int, list[np.ndarray]] = defaultdict(list)

    def add(self, at: int, bitmap: np.ndarray) -> None:
        """``bitmap`` becomes the adder's own."""
        bits = self.columns[at]
        bits.append(bitmap)
        while len(bits) > 2:
            a, b, c = bits
            x = a ^ b
            a &= b
            np.bitwise_xor(x, c, out=b)
            x &= c
            a |= x
            bits[:] = [b]
            at += 1
            bits = self.columns[at]
            bits.append(a)

    def slices(self) -> list[np.ndarray | None]:
        """Slices of the sum, lowest first; None where no bitmap came."""
        out: list[np.ndarray | None] = []
        while any(len(out) <= c for c, bits in self.columns.items() if bits):
            bits = self.columns.pop(len(out), [])
            if len(bits) == 2:
                self.add(len(out) + 1, bits[0] & bits[1])
                bits = [bits[0] ^ bits[1]]
            out.append(bits[0] if bits else None)
        return out


class BitSlicedIndex:
    """Integer inner products over blocks; see :class:`vector_blocks.Searcher`."""

    score = int

    def __init__(self, dropped: int = DROPPED, batch: int = BATCH):
        self.dropped, self.batch = dropped, batch

    def build(self, ids: np.ndarray, vectors: np.ndarray) -> dict:
        values = quantise(vectors)
        above = (values - values.min(axis=0)).T >> self.dropped  # components by rows, from 0
        width = int(above.max()).bit_length()
        words = -(-values.shape[0] // 64)
        slices = np.zeros((above.shape[0], width, words * 8), np.uint8)
        for j in range(width):
            packed = np.packbits((above >> j & 1).astype(np.uint8), axis=1, bitorder="little")
            slices[:, j, :packed.shape[1]] = packed
        there = np.zeros(words * 8, np.uint8)
        bits = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
        there[:len(bits)] = bits
        return {"ids": ids, "values": narrow(values), "slices": slices.view(np.uint64), "there": there.view(np.uint64)}

    def ask(self, block: dict, rows: np.ndarray) -> dict:
        return {"ids": block["ids"][rows], "values": block["values"][rows]}

    def sums(self, block: dict, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(|w| * q) per query and row, where q is the quantised
        component, or its complement for a negative weight."""
        shape = (len(weights), block["slices"].shape[2])
        size = np.abs(weights)
        flip = np.where(weights < 0, ONES, np.uint64(0))
        on = [np.where(size >> i & 1 == 1, ONES, np.uint64(0)) for i in range(int(size.max(initial=0)).bit_length())]
        adder = Adder()
        for d in range(weights.shape[1]):
            used = [(i, bit[:, d, None]) for i, bit in enumerate(on) if bit[:, d].any()]
            for j in range(block["slices"].shape[1] if used else 0):
                bits = block["slices"][d, j][None, :] ^ flip[:, d, None]
                for i, bit in used:
                    adder.add(i + j, bits & bit)
        return [np.zeros(shape, np.uint64) if s is None else s for s in adder.slices()]

    def boundary(self, block: dict, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows that may be among a query's k best."""
        there = block["there"]
        slices = self.sums(block, weights)
        n = len(block["ids"])
        sure = np.zeros((len(weights), len(there)), np.uint64)
        equal = np.repeat(there[None, :], len(weights), axis=0)
        kth = np.zeros(len(weights), np.int64)
        for c in range(len(slices) - 1, -1, -1):
            more = sure | (equal & slices[c])
            enough = np.bitwise_count(more).sum(axis=1) >= min(k, n)
            kth += enough.astype(np.int64) << c
            sure = np.where(enough[:, None], sure, more)
            equal = equal & np.where(enough[:, None], slices[c], ~slices[c])
        # what the dropped bits can add, in units of the quantised score
        slack = np.abs(weights).sum(axis=1) * (2**self.dropped - 1) >> self.dropped
        least = np.maximum(kth - slack, 0)
        over, equal = np.zeros_like(sure), np.repeat(there[None, :], len(weights), axis=0)
        for c in range(len(slices) - 1, -1, -1):
            bit = np.where(least >> c & 1 == 1, ONES, np.uint64(0))[:, None]
            over |= equal & slices[c] & ~bit
            equal &= ~(slices[c] ^ bit)
        bits = np.unpackbits((over | equal).view(np.uint8), axis=1, bitorder="little", count=n)
        return np.nonzero(bits)

    def best(self, block: dict, queries: dict, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.full((len(own), k), -1, np.int64)
        scores = np.full((len(own), k), vb.lowest(int), np.int64)
        for at in range(0, len(own), self.batch):
            weights = queries["values"][at:at + self.batch].astype(np.int64)
            q, rows = self.boundary(block, weights, k + 1)  # one more: a query may find itself
            keep = rows != own[at + q]
            q, rows = q[keep], rows[keep]
            exact = np.einsum("ij,ij->i", weights[q], block["values"][rows].astype(np.int64))
            order = np.lexsort((block["ids"][rows], -exact, q))
            q, rows, exact = q[order], rows[order], exact[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            top = place < k
            ids[at + q[top], place[top]], scores[at + q[top], place[top]] = block["ids"][rows[top]], exact[top]
        return ids, scores


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          dropped: int = DROPPED) -> DataFrame:
    """query_id, rank, vec_id and score (bigint) of the k highest integer inner
    products of each row whose id is divisible by ``every``, ties to the smaller
    id, with components floor(256 * x).

    Rows with a null id, and vectors that are null, empty or hold null or
    non-finite components, take no part; zero vectors do.  A query has
    candidates of its own length only.  Repeated rows are candidates of each
    other and queries of their own.  An empty table gives an empty result.
    Scores are 64-bit; components are taken to be small enough for that."""
    ok = vb.finite_vectors(vectors, vec_id, vector, zeros=True)
    index = BitSlicedIndex(dropped)
    return vb.search(vb.build_blocks(ok, index), index, lambda ids: ids % every == 0, k)
