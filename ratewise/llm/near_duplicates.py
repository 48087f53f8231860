"""Operator 4: MinHash near-duplicates by a multi-index Hamming join.

A text's word shingles become a signature of ``SYMBOLS`` b-bit minhashes.  Two
texts whose signatures differ in at most ``DISTANCE`` symbols agree, by the
pigeonhole principle, on one of ``CHUNKS`` chunks up to ``DISTANCE // CHUNKS``
symbols.  So every signature is posted under each of its chunks with each
choice of that many symbols left open: an equi-join on these keys yields all
pairs under the distance threshold.  Their full shingle sets are then compared.

Texts with equal sets are one representative throughout, and are never paired.
No step writes all pairs of a group.  The members of a key are compared by
signature in one task (in blocks where a key is frequent), which writes a
spanning forest of the pairs under the threshold; these forests join into
candidate groups.  In a candidate group every set is first compared with one
other, then those that this links with nothing are compared with all the rest,
again in blocks that write spanning forests of the confirmed links.  So the
classes are those of all confirmed pairs, and work beyond the size of a group
goes only to texts that are alike and yet not linked with its first one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.session import checkpoint_dir

#: Words of a shingle, and the least similarity of linked texts in hundredths.
SHINGLE, SIMILAR = 5, 85

#: Signatures: 16-bit symbols.  At similarity 0.85 a symbol differs with
#: probability 0.15; more than 21 of 64 differ in about 1 of 10,000 such pairs,
#: and of pairs at 0.88 or above in about 1 of a million.
SYMBOLS, DISTANCE, CHUNKS = 64, 21, 11
#: Rows of a block of a frequent key or a large group.
BLOCK = 512
#: Shingles hashed at a time.
PART = 16_384
#: Names of texts that are broadcast at most (16 bytes each).
BROADCAST_ROWS = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text: words are runs of
    anything but ascii white space, A-Z in lower case; fewer words than
    ``size`` are one shingle, no words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out + h[i:len(h) - n + 1 + i]) + _MIX
    return np.unique(out)


def signature(sets: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each of SYMBOLS hash functions, of
    which 16 bits are kept."""
    out = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), PART):  # a part of a long text at a time, under few functions
        part = sets[None, at:at + PART]
        for a in range(0, SYMBOLS, 8):
            h = part * _MUL[a:a + 8, None]
            h ^= h >> np.uint64(29)
            h *= _MIX
            np.minimum(out[a:a + 8], h.min(axis=1), out=out[a:a + 8])
    return (_mixed(out) >> np.uint64(48)).astype("<u2")


def open_places(distance: int = DISTANCE, chunks: int = CHUNKS, symbols: int = SYMBOLS) -> list[tuple[int, ...]]:
    """The symbols behind each key: for every chunk, all choices of its symbols
    that leave out as many as a chunk may have wrong."""
    from itertools import combinations

    errors, out = distance // chunks, []
    for chunk in np.array_split(np.arange(symbols), chunks):
        out += [tuple(int(x) for x in keep) for keep in combinations(chunk, len(chunk) - errors)]
    return out


def keys(signatures: np.ndarray, places: list[tuple[int, ...]]) -> np.ndarray:
    """64-bit keys of signatures (n, SYMBOLS), as (n, len(places))."""
    out = np.empty((len(signatures), len(places)), np.uint64)
    wide = signatures.astype(np.uint64) + np.uint64(1)
    for i, keep in enumerate(places):
        h = np.full(len(signatures), i + 1, np.uint64) * _MIX
        for p in keep:
            h = _mixed(h + wide[:, p] * _PLACE[p % 64])
        out[:, i] = h
    return out


def _scratch(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/ratewise-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, loc, n_shingles, set1, set2, sig) per row of ``docs``: a hash
    that finds the text again, the size of its set, 128 bits that name the set,
    and the signature (null if empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                sets = shingles(text.as_py())
                a, b = np.frombuffer(xxhash.xxh3_128_digest(sets.tobytes()), "<i8")
                rows.append((len(sets), int(a), int(b), signature(sets).tobytes() if len(sets) else None))
            n, a, b, sig = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()),
                                              pa.array(b, pa.int64()), pa.array(sig, pa.binary())],
                                             names=["doc_id", "loc", "n_shingles", "set1", "set2", "sig"])

    return located(docs).mapInArrow(run, "doc_id bigint, loc bigint, n_shingles bigint, set1 bigint, set2 bigint, sig binary")


def located(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("loc"), text.alias("text"))


def postings(reps: DataFrame) -> DataFrame:
    """(key, rep): every representative under each of its keys."""
    places = open_places()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS)
                k = keys(sig, places)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64).ravel()),
                                                  pa.array(np.repeat(part.column(0).to_numpy(), k.shape[1]))], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key bigint, rep bigint")


def shared_postings(posted: DataFrame) -> DataFrame:
    """The postings whose key another representative has too."""
    shared = posted.groupBy("key").count().where("count > 1").select("key")
    return posted.join(shared, "key", "left_semi")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal values in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            yield pa.concat_batches(held)
            held = []
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for i, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            if i:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.concat_batches(held)


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of a graph on n nodes, its edges given in parts."""
    parent = list(range(n))
    out = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for us, vs in pairs:
        for u, v in zip(us.tolist(), vs.tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[b] = a
                out.append((u, v))
    return out


def _written(batches: Iterator[tuple[np.ndarray, list[tuple[int, int]]]]) -> Iterator[pa.RecordBatch]:
    a: list = []
    b: list = []
    for reps, edges in batches:
        if edges:
            e = np.array(edges)
            a.append(reps[e[:, 0]])
            b.append(reps[e[:, 1]])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def candidate_links(shared: DataFrame, reps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): spanning forests, key by key, of the pairs that share a key and
    differ in ``distance`` symbols at most.  Together they connect what all
    such pairs connect."""
    sizes = shared.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    cut = (shared.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
           .select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "rep"))
    cut = cut.join(reps.select("rep", "sig", "n_shingles"), "rep").select("key", "lo", "hi", "rep", "n_shingles", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forests() -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
            for g in _groups(batches, 3):
                n, size = g.num_rows, g.column(4).to_numpy()
                sig = np.frombuffer(b"".join(g.column(5).to_pylist()), "<u2").reshape(n, SYMBOLS)

                def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                    for i in range(n - 1):
                        ok = ((sig[i + 1:] != sig[i]).sum(axis=1) <= distance) & (
                            np.minimum(size[i + 1:], size[i]) * 100 >= np.maximum(size[i + 1:], size[i]) * SIMILAR)
                        if ok.any():
                            v = np.flatnonzero(ok) + i + 1
                            yield np.full(len(v), i), v

                yield g.column(3).to_numpy(), _forest(n, pairs())

        yield from _written(forests())

    return cut.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a bigint, b bigint").distinct()


def linked_across(members: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): spanning forests of the similar pairs among ``members`` (group,
    rep, near) of which one side at least is not ``near``.  Both kinds are cut
    into blocks; every two blocks that hold such pairs meet in a task."""
    sizes = members.groupBy("group").agg(F.ceil(F.sum(F.col("near").cast("int")) / block).cast("int").alias("nears"),
                                         F.ceil(F.sum(F.lit(1) - F.col("near").cast("int")) / block).cast("int").alias("fars"))
    # blocks of a group: the far ones from 0, then the near ones; a near block meets far blocks only
    parts = F.when(F.col("near"), F.col("nears")).otherwise(F.col("fars"))
    part = F.pmod(F.xxhash64("rep"), parts).cast("int") + F.when(F.col("near"), F.col("fars")).otherwise(0)
    meets = F.sequence(F.lit(0), F.when(F.col("near"), F.col("fars")).otherwise(F.col("fars") + F.col("nears")) - 1)
    cut = (members.join(sizes.where("fars > 0"), "group").withColumn("part", part).withColumn("other", F.explode(meets))
           .select("group", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "rep", "near"))
    cut = cut.join(texts, "rep").select("group", "lo", "hi", "rep", "near", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forests() -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
            for g in _groups(batches, 3):
                near = g.column(4).to_numpy(zero_copy_only=False)
                sets = [shingles(t.as_py()) for t in g.column(5)]
                yield g.column(3).to_numpy(), _forest(len(sets), similar_pairs(sets, near))

        yield from _written(forests())

    return cut.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi").mapInArrow(run, "a bigint, b bigint")


def similar_pairs(sets: list[np.ndarray], near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All similar pairs with a side that is not near, exactly: common shingles
    are counted along the lists of who holds a shingle."""
    size = np.array([len(x) for x in sets])
    holders, owner = np.unique(np.concatenate(sets), return_inverse=True)
    who = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(owner, kind="stable")
    lists = np.searchsorted(owner[by], np.arange(len(holders) + 1))
    starts = np.concatenate([[0], np.cumsum(size)])
    for i in np.flatnonzero(~near):
        mine = owner[starts[i]:starts[i + 1]]
        held = np.concatenate([by[lists[s]:lists[s + 1]] for s in mine])
        common = np.bincount(who[held], minlength=len(sets))
        ok = 100 * common >= SIMILAR * (size + size[i] - common)
        ok[i] = False
        v = np.flatnonzero(ok)
        if len(v):
            yield np.full(len(v), i), v


def texts_of(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, text) of all representatives in ``pairs``, written.  The names of
    wanted texts are broadcast while they are few; more are joined."""
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = _scratch(wanted.join(reps.select("rep", "loc"), "rep"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # copies of a text are one row of each task before any text is shuffled
    found = located(docs).join(wanted, "loc").groupBy("rep").agg(F.first("text").alias("text"))
    return _scratch(found, "texts")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough.  Rows meet
    sorted by ``a``, whose set is made once for all its pairs."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.empty(0, np.uint64)
        for batch in batches:
            ok = []
            for a, s, t in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, x = a, shingles(s.as_py())
                y = shingles(t.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= SIMILAR * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(compare, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(rep, component) for every endpoint of ``links`` (a, b): the smallest
    reachable one.  Alternating large-star and small-star steps, each a
    minimum per node with partial aggregation, until nothing moves; the table
    of a step is written, so a lost executor costs one step.  So are the minima
    that edges are joined with: a join of two written tables may be split where
    a node has many neighbours, one that shares its exchange with an aggregate
    may not."""
    edges = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct()
    edges, state = _scratch(edges, "edges"), None
    while True:
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _scratch(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = edges.join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = (joined.select(F.col("m").alias("u"), "v").union(joined.select(F.col("m").alias("u"), F.col("u").alias("v")))
                 .where("u < v").distinct())
        edges = _scratch(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("v").alias("rep"), F.col("u").alias("component")).union(
        edges.select(F.col("u").alias("rep"), F.col("u").alias("component"))).distinct()


def classes(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, component) of the representatives that have links.  ``reps``: rep,
    loc, sig, n_shingles."""
    shared = _scratch(shared_postings(postings(reps)), "postings")
    groups = components(_scratch(candidate_links(shared, reps), "candidates")).select("rep", F.col("component").alias("group"))
    star = groups.where("rep <> group").select(F.col("group").alias("a"), F.col("rep").alias("b"))
    texts = texts_of(star, reps, docs)
    links = _scratch(confirmed(star, texts), "links")
    # a pair is settled by its one comparison; larger groups may hold links beside the first one's
    larger = groups.groupBy("group").count().where("count > 2").select("group")
    linked = links.select(F.col("b").alias("rep"), F.lit(True).alias("linked"))
    members = (groups.join(larger, "group").join(linked, "rep", "left")
               .select("group", "rep", (F.coalesce("linked", F.lit(False)) | (F.col("rep") == F.col("group"))).alias("near")))
    more = _scratch(linked_across(_scratch(members, "members"), texts), "links")
    return components(links.union(more))


def near_duplicates(docs: DataFrame, names: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``
    (doc_id, text); with ``names`` also the class's number and the text's hash.

    Texts without words are linked with nothing.  Rows with equal sets share a
    class, whatever their ids.  component_id is the smallest id of the class,
    null if it has none; a row with a null id is kept only in a class without
    ids.  Repeated rows come out alike.  An empty table gives an empty result;
    other columns are not looked at.

    Sets go by 128 bits, representatives by 64 bits of these: among 10^8
    different texts any two share a name with a chance below 1 in 1,000."""
    rows = _scratch(described(docs), "signatures")
    some = rows.where("n_shingles > 0")
    sets = some.groupBy("set1", "set2").agg(F.min("doc_id").alias("least"), F.min(F.struct("loc", "sig", "n_shingles")).alias("one"))
    sets = _scratch(sets.select("set1", "set2", F.xxhash64("set1", "set2").alias("rep"), "least", "one.*"), "sets")
    labels = classes(sets.select("rep", "loc", "sig", "n_shingles"), docs)
    named = sets.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("set1", "set2", "component_id", F.col("component").alias("class"))
    out = some.join(named, ["set1", "set2"]).select("doc_id", "n_shingles", "component_id", "class", "loc")
    out = out.union(rows.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class"), "loc"))
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out if names else out.select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, with its columns: the one with the
    smallest id.  All texts without words are kept.  Of repeated rows of that
    id one stays; a class without ids keeps one row."""
    found = near_duplicates(docs, names=True)
    stay = found.where("kept AND n_shingles > 0").groupBy("class").agg(F.min(F.struct("doc_id", "loc")).alias("one"))
    stay = stay.select(F.col("one.doc_id").alias("id"), F.col("one.loc").alias("loc"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no column of docs meets a name of ours
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("loc"))
    same = keyed["id"].eqNullSafe(stay["id"]) & (keyed["loc"] == stay["loc"])
    kept = keyed.join(stay, same, "left_semi").dropDuplicates(["id", "loc"])
    empty = keyed.where(~F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.unionByName(empty).select("row.*")
