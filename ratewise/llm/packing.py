"""Operator 9: best-fit packing planned on the length histogram.

Documents become token ids and are cut at the capacity.  How pieces share
sequences depends on their lengths alone, so best-fit decreasing runs over the
histogram: one step places all pieces of a length into all open sequences with
the same room.  The plan is as large as the capacity allows, whatever the
corpus size; pieces then take planned slots by their rank within their length.

Tokens are made once, by tasks that read whole texts and write narrow piece
rows to the shared folder.  Ranks come from counts per (length, bucket) and
row numbers within a bucket, so a length that a third of all pieces share is
spread over many tasks.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.tokens import encoder
from ratewise.session import checkpoint_dir

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of ``docs``, and a
    ``salt`` that tells repeated rows apart.  A null or empty text is the one id
    ``end_id``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        salt = TaskContext.get().partitionId() << 32
        for batch in batches:
            row, n, start, length, crc = [], [], [], [], []
            texts = (t.as_py() or "" for t in batch.column(1))
            for i, ids in enumerate(encode(texts)):
                ids += end
                size = len(ids) // 4
                for at in range(0, size, capacity):
                    part = ids if size <= capacity else ids[4 * at:4 * (at + capacity)]
                    row.append(i)
                    n.append(at // capacity)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int32()),
                 *[pa.array(c, pa.int64()) for c in (start, length, crc, range(salt, salt + len(row)))]],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
            salt += len(row)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.  Returns runs (length, first rank,
    count, first sequence, offset): the pieces of that length with ranks from
    ``first rank`` stand in consecutive sequences, at that offset in each.

    All sequences with equal room form groups of consecutive numbers.  The
    pieces of one length go to the tightest groups that fit, one per sequence;
    what a group can still take is met again as a group with less room."""
    runs: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)
    rooms: list[int] = []  # sorted
    made = 0
    for length in sorted((n for n in histogram if histogram[n] > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):  # open new sequences, each with as many of this length as fit
                each = capacity // length
                full, rest = divmod(left, each)
                for count, per in ((full, each), (1 if rest else 0, rest)):
                    if count:
                        for k in range(per):
                            runs.append((length, rank, count, made, k * length))
                            rank += count
                        _add(groups, rooms, capacity - per * length, made, count)
                        made += count
                left = 0
                continue
            room = rooms[i]
            first, count = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            take = min(count, left)
            runs.append((length, rank, take, first, capacity - room))
            rank, left = rank + take, left - take
            _add(groups, rooms, room - length, first, take)
            _add(groups, rooms, room, first + take, count - take)
    return runs


def _add(groups: dict[int, list[tuple[int, int]]], rooms: list[int], room: int, first: int, count: int) -> None:
    if room > 0 and count > 0:
        if room not in groups:
            bisect.insort(rooms, room)
        groups[room].append((first, count))


def ranked(df: DataFrame, rows_per_bucket: int = 1_000) -> tuple[DataFrame, dict[int, int]]:
    """Adds ``rank`` (from 0, unique within a length), and the histogram.  Rows
    are numbered inside buckets hashed from their salt; a bucket's first number
    is the count of those before it.  One bucket's rows of one length, never all
    rows of a length, meet in a task."""
    counts = {r["length"]: r["count"] for r in df.groupBy("length").count().collect()}  # capacity rows at most
    buckets = [-(-counts.get(n, 0) // rows_per_bucket) for n in range(max(counts, default=0) + 1)]
    df = df.withColumn("bucket", F.pmod(F.xxhash64("salt"), F.get(F.lit(buckets), F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (df.groupBy("length", "bucket").count()
             .select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("length", "bucket").orderBy("salt")
    out = df.withColumn("i", F.row_number().over(inside) - 1).join(first, ["length", "bucket"])
    return out.withColumn("rank", (F.col("first") + F.col("i")).cast("long")).drop("bucket", "first", "i"), counts


PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of ``capacity`` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id and
    offset.  Null and empty texts are one token long; longer documents than the
    capacity, of any length, are cut and nothing is dropped.  Repeated rows, and
    rows with a null id, are packed once each.  An empty table gives an empty
    result; other columns are not looked at."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/ratewise-tables/pieces-{uuid.uuid4().hex}"
    pieces(docs, capacity, vocabulary).write.parquet(path)
    table, histogram = ranked(spark.read.parquet(path))
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, rank, _, sequence, offset in plan(histogram, capacity):
        runs[length].append((rank, sequence, offset))
    slots = {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, seq, off = slots[int(n)]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return table.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PACKED)
