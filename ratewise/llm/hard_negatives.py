"""Operator 12: hard negatives from Hilbert-ordered blocks with zone maps.

Rows are ordered by label and along a Hilbert curve through a few projections
of their vectors, and cut into blocks of equal size.  A block is one row of a
Parquet table whose folders hold runs of the curve; its zone map keeps the least
and the greatest value of every dimension, and the range of its labels.

An anchor's inner products with a block lie between two sums over dimensions,
each of the smaller or the larger of its component times the zone's ends.
These bounds choose what is read: folders that no anchor needs are not scanned
(the join on the folder prunes partitions), blocks and anchors that cannot
meet are not multiplied, and what was found raises the bound further.  Nothing
is dropped by a guess: whatever the data, the results are exact.  Where zone
maps tell nothing, as for vectors without any structure, all blocks are read.

Anchors are met in rounds of a fixed number of bytes, each with every block, so
neither the blocks nor the anchors of all rounds are shuffled or held.  The
driver holds one round's anchors and their positives.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.session import checkpoint_dir

#: Rows of a block, and blocks of a folder.
BLOCK_ROWS, FOLDER_BLOCKS = 1024, 16
#: Bytes of the anchors' vectors of one round; they travel with the tasks.
ROUND_BYTES = 16_000_000
#: Projections that the curve runs through, and bits of each.
AXES, BITS = 6, 10
#: Scores of one multiplication, and pairs that a task keeps before it thins them out.
SCORES, PAIRS = 4_000_000, 500_000
NONE = -(1 << 62)  # below any score


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers of ``bits`` bits
    (J. Skilling, Programming the Hilbert curve, 2004)."""
    x = cells.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for axis in x:
            turned = axis >> b & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap)
            axis ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x ^ flip:
            key = key << 1 | (axis >> b & 1)
    return key


def curve_place(vectors: np.ndarray) -> np.ndarray:
    """Hilbert key of each vector's direction: cosines to fixed axes, spread
    evenly over the cells."""
    dim = vectors.shape[1]
    axes = np.eye(dim) if dim <= AXES else np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, AXES)))[0]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    cosines = (vectors / np.where(length > 0, length, 1)) @ axes
    even = 1 / (1 + np.exp(-1.702 * np.sqrt(dim) * cosines))
    return hilbert_key(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def matrices(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, their vectors as a matrix) for each length of list."""
    sizes = np.diff(lists.offsets.to_numpy())
    ends, values = np.cumsum(sizes), lists.flatten().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, values[(ends[at] - dim)[:, None] + np.arange(dim)]


def integer_vectors(df: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """(id, label, vec) with floor(256 * x) of every component, of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("vec"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", number))
            .withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(256.0)))).where(square < F.lit(float(1 << 62))))


_ROW = "salt bigint, id bigint, label bigint, vec array<bigint>"
_BLOCK = ("folder int, block bigint, dim int, label_low bigint, label_high bigint, low array<bigint>, high array<bigint>, "
          "salts array<bigint>, ids array<bigint>, labels array<bigint>, vectors binary")


def build_blocks(vectors: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The table of blocks.  Every row has a salt, so that equal rows part too."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for dim, at, m in matrices(batch.column(3)):
                dims[at], keys[at] = dim, curve_place(m.astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(keys)],
                                             names=["salt", "id", "label", "vec", "dim", "key"])

    spark = vectors.sparkSession
    salted = vectors.select(F.monotonically_increasing_id().alias("salt"), "id", "label", "vec")
    salted.mapInArrow(place, f"{_ROW}, dim int, key bigint").write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    folders = max(1, -(-placed.count() // (block_rows * FOLDER_BLOCKS)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # dim, salts, ids, labels, matrix: less than a block, of one dim
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal made, held, size
            dim = held[0][0]
            salts, ids, labels, m = (np.concatenate(c) for c in list(zip(*held, strict=True))[1:])
            held, size, made = [], 0, made + 1
            cols = [[folder], [(folder << 32) + made], [dim], [labels.min()], [labels.max()], [m.min(0)], [m.max(0)], [salts], [ids], [labels],
                    [m.astype("<i8").tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                              names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            salts, ids, labels = (batch.column(i).to_numpy() for i in range(3))
            for dim, at, m in matrices(batch.column(3)):  # rows are sorted by dim first
                if held and held[0][0] != dim:
                    yield block()
                i = 0
                while i < len(at):
                    some = slice(i, i + block_rows - size)
                    held.append((dim, salts[at[some]], ids[at[some]], labels[at[some]], m[some]))
                    size += len(held[-1][1])
                    i += len(held[-1][1])
                    if size == block_rows:
                        yield block()
        if held:
            yield block()

    order = ["dim", "label", "key", "id", "salt"]
    ordered = placed.repartitionByRange(folders, *order).sortWithinPartitions(*order).select("salt", "id", "label", "vec")
    ordered.mapInArrow(cut, _BLOCK).write.partitionBy("folder").parquet(f"{path}/blocks")
    schema = placed.sparkSession.createDataFrame([], _BLOCK).schema  # a table without rows has no files
    return spark.read.schema(schema).parquet(f"{path}/blocks")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products.  Vectors' lengths bound all partial sums."""
    longest = np.linalg.norm(a.astype(float), axis=1).max(initial=0) * np.linalg.norm(b.astype(float), axis=1).max(initial=0)
    if longest < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def best_per(group: np.ndarray, score: np.ndarray, ids: np.ndarray, salts: np.ndarray, k: int) -> np.ndarray:
    """Which entries are the k best of their group: highest score, then smallest id."""
    order = np.lexsort((salts, ids, -score, group))
    g = group[order]
    first = np.searchsorted(g, g, "left")
    return order[np.arange(len(g)) - first < k]


class Anchors:
    """One round's anchors of one dimension."""

    def __init__(self, salts: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, least: np.ndarray):
        self.salts, self.ids, self.labels, self.vectors, self.least = salts, ids, labels, vectors, least
        # positives, filled in between: ids and scores, best first; NONE where there are fewer
        self.positive_ids = self.positive_scores = np.zeros((len(ids), 0), np.int64)

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product of each anchor (row) with any vector of
        each zone (column), made a little wider for rounding."""
        a, low, high = self.vectors.astype(float), low.astype(float), high.astype(float)
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        slack = 1 + 1e-9 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T)
        return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


class Positives:
    """The best rows of an anchor's own label."""

    def __init__(self, k: int):
        self.k, self.windows = k, 1

    def needs(self, a: Anchors, least: np.ndarray, low: np.ndarray, high: np.ndarray, label_low: np.ndarray, label_high: np.ndarray) -> np.ndarray:
        own = (label_low <= a.labels[:, None]) & (a.labels[:, None] <= label_high)
        return own & (a.bounds(low, high)[1] >= least[:, :1])

    def pairs(self, a: Anchors, some: np.ndarray, least: np.ndarray, scores: np.ndarray, labels: np.ndarray, salts: np.ndarray) -> Iterator[tuple]:
        yield 0, (labels == a.labels[some, None]) & (salts != a.salts[some, None]) & (scores >= least[some, :1])

    def least(self, a: Anchors) -> np.ndarray:
        return a.least[:, None].copy()


class Negatives:
    """The best rows of other labels in each positive's window of scores."""

    def __init__(self, k: int, windows: int, low_percent: int, high_percent: int):
        self.k, self.windows, self.low, self.high = k, windows, low_percent, high_percent

    def window(self, a: Anchors) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score of each (anchor, positive): low * p <= 100 * s <= high * p."""
        p = a.positive_scores
        whole, rest = p // 100, p % 100  # in two parts, so that no product passes 64 bits
        low = whole * self.low - (-(rest * self.low) // 100)
        high = whole * self.high + rest * self.high // 100
        return np.where(p > NONE, low, 0), np.where(p > NONE, high, -1)

    def needs(self, a: Anchors, least: np.ndarray, low: np.ndarray, high: np.ndarray, label_low: np.ndarray, label_high: np.ndarray) -> np.ndarray:
        only_own = (label_low == a.labels[:, None]) & (label_high == a.labels[:, None])
        smallest, greatest = a.bounds(low, high)
        top = self.window(a)[1]
        out = np.zeros(smallest.shape, bool)
        for w in range(self.windows):
            out |= (least[:, w:w + 1] <= top[:, w:w + 1]) & (greatest >= least[:, w:w + 1]) & (smallest <= top[:, w:w + 1])
        return out & ~only_own

    def pairs(self, a: Anchors, some: np.ndarray, least: np.ndarray, scores: np.ndarray, labels: np.ndarray, salts: np.ndarray) -> Iterator[tuple]:
        other, top = labels != a.labels[some, None], self.window(a)[1][some]
        for w in range(self.windows):
            yield w, other & (scores >= least[some, w:w + 1]) & (scores <= top[:, w:w + 1])

    def least(self, a: Anchors) -> np.ndarray:
        return self.window(a)[0]


Search = Positives | Negatives
_FOUND = "dim int, anchor int, window int, id bigint, score bigint, salt bigint"


def needed_folders(blocks: DataFrame, anchors: dict[int, Anchors], search: Search, path: str) -> DataFrame:
    """(folder, pairs): how many pairs of anchor and block a folder's zones admit."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folder, label_low, label_high = (batch.column(i).to_numpy() for i in range(3))
            pairs = np.zeros(batch.num_rows, np.int64)
            highs = {dim: m for dim, _, m in matrices(batch.column(4))}
            for dim, at, low in matrices(batch.column(3)):
                if dim in anchors:
                    a = anchors[dim]
                    step = max(1, SCORES // len(a.ids))
                    for i in range(0, len(at), step):
                        z = slice(i, i + step)
                        pairs[at[z]] = search.needs(a, search.least(a), low[z], highs[dim][z], label_low[at[z]], label_high[at[z]]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(folder), pa.array(pairs)], names=["folder", "pairs"])

    zones = blocks.select("folder", "label_low", "label_high", "low", "high")
    counts = zones.mapInArrow(look, "folder int, pairs bigint").groupBy("folder").agg(F.sum("pairs").alias("pairs"))
    counts.write.parquet(path)
    return blocks.sparkSession.read.parquet(path)


def meet(blocks: DataFrame, anchors: dict[int, Anchors], search: Search, path: str) -> DataFrame:
    """The k best rows found per anchor and window, over all blocks that the
    zone maps admit."""
    k, windows = search.k, search.windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {dim: search.least(a) for dim, a in anchors.items()}
        held: dict[int, list[np.ndarray]] = {dim: [] for dim in anchors}  # (group, score, id, salt) columns

        def thin(dim: int) -> None:
            found = np.concatenate(held[dim], axis=1)
            found = found[:, best_per(*found, k)]
            held[dim] = [found]
            group, n = np.unique(found[0], return_counts=True)
            full = group[n == k]
            if len(full):  # the k-th best found so far: no worse one is wanted
                worst = found[1][np.cumsum(n)[n == k] - 1]
                at = least[dim][full // windows, full % windows]
                least[dim][full // windows, full % windows] = np.maximum(at, worst)

        def block(dim: int, labels: np.ndarray, low: np.ndarray, high: np.ndarray, salts: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
            a = anchors[dim]
            edge = lambda x: np.array([x])
            need = np.flatnonzero(search.needs(a, least[dim], low[None], high[None], edge(labels.min()), edge(labels.max()))[:, 0])
            step = max(1, SCORES // len(ids))
            for i in range(0, len(need), step):
                some = need[i:i + step]
                scores = products(a.vectors[some], m)
                for w, hit in search.pairs(a, some, least[dim], scores, labels, salts):
                    row, col = np.nonzero(hit)
                    if len(row) > 2 * k * len(some):  # many at once: the best of this block alone
                        got = best_per(row, scores[row, col], ids[col], salts[col], k)
                        row, col = row[got], col[got]
                    if len(row):
                        held[dim].append(np.stack([some[row] * windows + w, scores[row, col], ids[col], salts[col]]))
                if sum(x.shape[1] for x in held[dim]) > PAIRS:
                    thin(dim)

        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column(0)[r].as_py()
                if dim in anchors:
                    low, high, salts, ids, labels = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(1, 6))
                    block(dim, labels, low, high, salts, ids, np.frombuffer(batch.column(6)[r].as_py(), "<i8").reshape(-1, dim))
        for dim in anchors:
            if held[dim]:
                thin(dim)
                group, score, ids, salts = held[dim][0]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                cols = (np.full(len(group), dim), group // windows, group % windows, ids, score, salts)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                 names=["dim", "anchor", "window", "id", "score", "salt"])

    folders = needed_folders(blocks, anchors, search, path).where("pairs > 0")
    wanted = blocks.join(folders, "folder", "left_semi")
    found = wanted.select("dim", "low", "high", "salts", "ids", "labels", "vectors").mapInArrow(run, _FOUND)
    best = Window.partitionBy("dim", "anchor", "window").orderBy(F.desc("score"), "id", "salt")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def anchor_rows(blocks: DataFrame, every: int, k: int, path: str, round_bytes: int = ROUND_BYTES) -> tuple[DataFrame, int]:
    """The anchors with ``least``, the k-th best score of their own label within
    their own block (NONE if it has fewer), dealt over rounds."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column(0)[r].as_py()
                salts, ids, labels = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(1, 4))
                m = np.frombuffer(batch.column(4)[r].as_py(), "<i8").reshape(-1, dim)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    scores = np.where((labels == labels[at, None]) & (salts != salts[at, None]), products(m[at], m), NONE)
                    least = -np.sort(-scores, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(at), NONE)
                    vec = [m[i].tobytes() for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array([dim] * len(at), pa.int32()), *map(pa.array, (salts[at], ids[at], labels[at], least)),
                                                      pa.array(vec, pa.binary())], names=["dim", "salt", "id", "label", "least", "vec"])

    spark = blocks.sparkSession
    shape = "dim int, salt bigint, id bigint, label bigint, least bigint, vec binary"
    blocks.select("dim", "salts", "ids", "labels", "vectors").mapInArrow(pick, shape).write.parquet(f"{path}/anchors")
    anchors = spark.read.parquet(f"{path}/anchors")
    rounds = -(-(anchors.agg(F.sum(F.length("vec"))).first()[0] or 0) // round_bytes)
    if rounds:  # dealt evenly, without a key
        anchors.repartition(rounds).withColumn("round", F.spark_partition_id()).write.partitionBy("round").parquet(f"{path}/rounds")
        anchors = spark.read.parquet(f"{path}/rounds")
    return anchors, rounds


def one_round(rows: pa.Table) -> dict[int, Anchors]:
    out = {}
    for dim in np.unique(rows["dim"].to_numpy()):
        part = rows.filter(pa.compute.equal(rows["dim"], int(dim)))
        vectors = np.frombuffer(b"".join(part["vec"].to_pylist()), "<i8").reshape(-1, dim)
        out[int(dim)] = Anchors(*(part[c].to_numpy() for c in ("salt", "id", "label")), vectors, part["least"].to_numpy())
    return out


MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100,
         vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", block_rows: int = BLOCK_ROWS,
         round_bytes: int = ROUND_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``.  For each of an
    anchor's best ``positives`` rows of its label come the best ``negatives``
    rows of other labels whose score s satisfies low * p <= 100 * s <= high * p
    for the positive's score p.  Scores are inner products of floor(256 * x);
    higher ones come first, ties by the smaller id.

    Rows with a null id or label, and vectors that are null, empty or hold null
    or non-finite components, take no part; nor do those whose squared length
    as integers is 2^62 or more, whose scores a long cannot hold.  Vectors of
    another length are no candidates.  Repeated rows are anchors of their own
    and candidates of each other.  A positive without negatives has no rows; an
    empty table gives an empty result; other columns are not looked at."""
    spark = vectors.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/ratewise-tables/hard-negatives-{uuid.uuid4().hex}"
    blocks = build_blocks(integer_vectors(vectors, vec_id, label, vector), path, block_rows)
    table, rounds = anchor_rows(blocks, every, positives, path, round_bytes)
    for r in range(rounds):
        anchors = one_round(table.where(F.col("round") == r).drop("round").toArrow())
        for a in anchors.values():
            a.positive_ids = np.full((len(a.ids), positives), NONE)
            a.positive_scores = np.full((len(a.ids), positives), NONE)
        for p in meet(blocks, anchors, Positives(positives), f"{path}/folders/p{r}").collect():
            a = anchors[p["dim"]]
            a.positive_ids[p["anchor"], p["rank"] - 1], a.positive_scores[p["anchor"], p["rank"] - 1] = p["id"], p["score"]
        found = meet(blocks, anchors, Negatives(negatives, positives, low_percent, high_percent), f"{path}/folders/n{r}")
        _named(found, anchors).write.parquet(f"{path}/mined/round={r}")
    if not rounds:
        return spark.createDataFrame([], MINED)
    return spark.read.parquet(f"{path}/mined").select(*[c.split()[0] for c in MINED.split(", ")])


def _named(found: DataFrame, anchors: dict[int, Anchors]) -> DataFrame:
    """Ids and positives' scores in place of the round's numbers."""
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, row, w = (batch.column(i).to_numpy() for i in range(3))
            ids, pos, score = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for dim in np.unique(dims):
                at, a = np.flatnonzero(dims == dim), anchors[int(dim)]
                ids[at], pos[at], score[at] = a.ids[row[at]], a.positive_ids[row[at], w[at]], a.positive_scores[row[at], w[at]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pos), batch.column(3), batch.column(4), pa.array(score), batch.column(5)],
                                             names=[c.split()[0] for c in MINED.split(", ")])

    return found.select("dim", "anchor", "window", F.col("rank").cast("int").alias("rank"), "id", "score").mapInArrow(name, MINED)
