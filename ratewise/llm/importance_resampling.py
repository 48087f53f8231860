"""Operator 11: importance resampling towards a target distribution.

Hashed n-grams of the raw corpus and of a target are counted in buckets.  A
bucket's gain is the logarithm of how much more frequent it is in the target;
a document's weight is the mean gain of its features.  Weight plus a Gumbel
value hashed from the id is the document's score, and the highest scores are
a sample without replacement in proportion to the weights' exponentials.

Every document is scanned once: its words, joined by single spaces, give the
running CRC-32 at each word's end.  A CRC of A followed by B is that of A,
shifted by B's length over GF(2), plus that of B; so any n-gram's CRC is two
prefixes' CRCs and a shift, and no n-gram is ever built as a string.  The
buckets go to a table in the shared folder (14 bits a feature), from which
counts and weights are read.

The driver holds the gains alone, one number per bucket.  Ranks come from a
range-partitioned sort of narrow rows and the partitions' sizes.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.session import checkpoint_dir

BUCKETS = 10_000
#: Words of texts that a task takes together; a longer text is taken alone.
WORDS = 400_000

#: Digits, small letters and all bytes of other characters stay; capitals
#: become small, all else white space.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Shifts:
    """CRC-32 of data followed by n zero bytes, without the constants that a
    CRC begins and ends with: linear over GF(2), as tables per power of two."""

    def __init__(self, powers: int = 40):
        byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
        self.byte = byte  # a register of b, shifted by one byte
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        images = (unit >> np.uint32(8)) ^ byte[unit & np.uint32(255)]
        self.tables = []
        for _ in range(powers):
            self.tables.append(self._table(images))
            images = self._apply(self.tables[-1], images)  # twice the shift

    @staticmethod
    def _table(images: np.ndarray) -> np.ndarray:
        """images[i] is what bit i becomes; the sum over each byte's bits."""
        bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)
        return np.array([np.bitwise_xor.reduce(np.where(bits, images[8 * k:8 * k + 8], 0), axis=1) for k in range(4)], np.uint32)

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        crc = crc.copy()
        for power in range(int(length.max(initial=0)).bit_length()):
            at = np.flatnonzero(length >> power & 1)
            crc[at] = self._apply(self.tables[power], crc[at])
        return crc

    def space(self, crc: np.ndarray) -> np.ndarray:
        """Of data whose CRC is ``crc``, followed by a space."""
        full = crc ^ np.uint32(0xFFFFFFFF)
        return (full >> np.uint32(8)) ^ self.byte[(full ^ np.uint32(0x20)) & np.uint32(255)] ^ np.uint32(0xFFFFFFFF)


class Prefixes:
    """Running CRCs of some documents, each scanned once."""

    def __init__(self, texts: list[str], shifts: Shifts):
        self.shifts = shifts
        counts, ends, sizes = [], [], []
        for text in texts:
            words = text.encode().translate(_WORD_BYTES).split()
            counts.append(len(words))
            ends += list(accumulate((b" " + w for w in words), lambda crc, w: zlib.crc32(w, crc), initial=0))[1:]
            sizes += map(len, words)
        self.n_words = np.array(counts, np.int64)
        self.end = np.array(ends, np.uint32)
        self.size = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        first = np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)
        self.left = first + self.n_words[self.doc] - np.arange(len(self.doc))  # words from here to the document's end
        before = np.concatenate([np.zeros(1, np.uint32), self.end])[:-1]
        before[first == np.arange(len(first))] = 0
        self.start = shifts.space(before) if len(before) else before
        self.reach = np.concatenate([[0], np.cumsum(self.size)])

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and CRC-32 of every run of n words, joined by one space."""
        at = np.flatnonzero(self.left >= n)
        length = self.reach[at + n] - self.reach[at] + n - 1
        return self.doc[at], self.end[at + n - 1] ^ self.shifts(self.start[at], length)


FEATURES = "doc_id bigint, salt bigint, n_words bigint, buckets array<int>"


def features(docs: DataFrame, ngrams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs`` its id, a ``salt`` that tells repeated rows apart, its
    number of words and the buckets of its runs of ``ngrams`` words, from the
    shortest to the longest; a null text has none."""
    low, high = ngrams

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, salt = Shifts(), TaskContext.get().partitionId() << 40

        def table(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            nonlocal salt
            prefixes = Prefixes(texts, shifts)
            found = [prefixes.ngrams(n) for n in range(low, high + 1)]
            doc, crc = (np.concatenate(c) for c in zip(*found, strict=True))
            if low < high:
                order = np.argsort(doc, kind="stable")
                doc, crc = doc[order], crc[order]
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((crc % buckets).astype(np.int32)))
            salts = pa.array(range(salt, salt + len(texts)), pa.int64())
            salt += len(texts)
            return pa.RecordBatch.from_arrays([ids, salts, pa.array(prefixes.n_words), lists], names=["doc_id", "salt", "n_words", "buckets"])

        for batch in batches:
            texts, begin, size = [], 0, 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                if texts and size + len(text) > 6 * WORDS:
                    yield table(batch.column(0).slice(begin, len(texts)), texts)
                    texts, begin, size = [], i, 0
                texts.append(text)
                size += len(text)
            if texts:
                yield table(batch.column(0).slice(begin, len(texts)), texts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, FEATURES)


def bucket_counts(table: DataFrame) -> DataFrame:
    """(bucket, n) over all features; a task sums up what it reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            some = np.bincount(batch.column(0).flatten().to_numpy())
            if len(some) > len(total):
                some, total = total, some.astype(np.int64)
            total[:len(some)] += some
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    return table.select("buckets").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain; both arguments are counts of at most ``buckets`` rows."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((corpus, s), (target, t)):
        for r in counts.collect():
            into[r["bucket"]] = r["n"]
    return np.array([math.floor(1000 * math.log((y + 1) * (s.sum() + buckets) / ((x + 1) * (t.sum() + buckets)))) for x, y in zip(s, t, strict=True)], np.int64)


def weighted(table: DataFrame, gains: np.ndarray) -> DataFrame:
    """n_features and the floored mean gain of each row's features (none: 0)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64)
            reach = np.concatenate([[0], np.cumsum(gains[lists.flatten().to_numpy()])])
            total, n = np.diff(reach[ends - ends[0]]), np.diff(ends)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(weight)],
                                             names=["doc_id", "salt", "n_words", "n_features", "weight"])

    return (table.select("doc_id", "salt", "n_words", "buckets")
            .mapInArrow(weigh, "doc_id bigint, salt bigint, n_words bigint, n_features bigint, weight bigint"))


def gumbel(seed: int, doc_id: str = "doc_id"):
    """A Gumbel value in thousandths, hashed from seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list, path: str) -> DataFrame:
    """Adds ``rank`` (from 1) in the order given, which must be total, and
    ``total``, the number of rows.  Rows are sorted over all partitions and
    written; a partition's first rank is the number of rows in those before."""
    rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    table = rows.sparkSession.read.parquet(path)
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    firsts = (table.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
              .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(every).alias("total")))
    return (table.withColumn("part", part).join(F.broadcast(firsts), "part")  # a row per partition of the sort
            .withColumn("rank", F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).drop("part", "first", "place"))


def resample(docs: DataFrame, target: DataFrame, ngrams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, min_words: int = 20,
             percent: int = 10, seed: int = 2024, target_id: str = "item_id") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``
    (doc_id, text); ``target`` holds the texts of the target distribution.

    Of the rows with at least ``min_words`` words, ``percent`` percent (floored)
    are drawn by highest score, ties to the smaller id; their ranks run from 1,
    those of all other rows are null.  Words are runs of digits, letters and
    characters beyond ascii; A-Z count as small.  Null and empty texts have no
    features and the weight 0.  The Gumbel value depends on the id, so repeated
    rows have one score each and ranks of their own; rows with a null id share
    one value and come before others of their score.  An empty target gives all
    features the gain of their rarity in ``docs``; an empty table an empty result."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ratewise-tables/resampling-{uuid.uuid4().hex}"
    features(docs, ngrams, buckets).write.parquet(f"{folder}/features")
    table = spark.read.parquet(f"{folder}/features")
    gains = bucket_gains(bucket_counts(table), bucket_counts(features(target, ngrams, buckets, target_id)), buckets)
    scored = weighted(table, gains).withColumn("score", F.col("weight") + gumbel(seed))
    scored.write.parquet(f"{folder}/scored")
    scored = spark.read.parquet(f"{folder}/scored")
    able = F.col("n_words") >= min_words
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked(scored.where(able), [F.desc("score"), F.asc_nulls_first("doc_id"), "salt"], f"{folder}/ranked")
    drawn = drawn.select(*columns, F.when(F.col("rank") <= F.expr(f"total * {int(percent)} div 100"), F.col("rank")).alias("rank"))
    return drawn.union(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
