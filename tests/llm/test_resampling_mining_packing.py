"""Operators 11, 12 and 13 against brute force on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ratewise.llm import hard_negatives, importance_resampling, sum_of_squares, tokens

# --- operator 11 -----------------------------------------------------------


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_resample(rows, target, ngrams, buckets, percent, min_words, seed):
    def feats(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(f for _, x in rows for f in feats(x)), Counter(f for x in target for f in feats(x))
    S, T = sum(s.values()), sum(t.values())
    gain = {f: math.floor(1000 * math.log((t[f] + 1) * (S + buckets) / ((s[f] + 1) * (T + buckets)))) for f in s}
    out = []
    for d, x in rows:
        f = feats(x)
        weight = sum(gain[y] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(x))])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    drawn = len(able) * percent // 100
    ranks = Counter((r[0], r[1], r[2], r[3], i + 1 if i < drawn else None) for i, r in enumerate(able))
    return ranks + Counter((r[0], r[1], r[2], r[3], None) for r in out if r[4] < min_words)


def noisy_texts(seed, n):
    r = random.Random(seed)
    signs = [*"abcXYZ019", " ", " ", "-", "é", "日", "\x00", "\x7f", "_", "\n", "\U0001f600"]
    return ["".join(r.choices(signs, k=r.randrange(0, 120))) for _ in range(n)]


def test_prefix_crcs_equal_those_of_built_ngrams():
    texts = [*noisy_texts(1, 50), "", "one", "w" * 70_000 + " " + "x y " * 500]
    prefixes = importance_resampling.Prefixes(texts, importance_resampling.Shifts())
    assert prefixes.n_words.tolist() == [len(words_of(t)) for t in texts]
    for n in (1, 2, 5):
        want = [(d, zlib.crc32(" ".join(w[i:i + n]).encode())) for d, t in enumerate(texts) for w in [words_of(t)] for i in range(len(w) - n + 1)]
        doc, crc = prefixes.ngrams(n)
        assert list(zip(doc.tolist(), crc.tolist(), strict=True)) == want


@pytest.mark.parametrize("ngrams, words", [((1, 1), 400_000), ((1, 3), 10)])
def test_resampling_matches_brute_force(spark, monkeypatch, ngrams, words):
    monkeypatch.setattr(importance_resampling, "WORDS", words)
    texts = noisy_texts(2, 300)
    rows = [(i * 7 % 290, t) for i, t in enumerate(texts)]  # ids that repeat with other texts
    rows += [(1000, None), (1001, ""), (1002, "short text"), (None, texts[0]), (None, texts[0]), (None, "a b " * 50), (1003, "very long " * 30_000)] + [rows[3]] * 3
    target = noisy_texts(3, 20) + [None, ""]
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, weight int, salt string, place int").repartition(5)
    goal = spark.createDataFrame([(i, t, 5) for i, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = importance_resampling.resample(docs, goal, ngrams, buckets=97, min_words=3, percent=25, seed=7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_resample(rows, target, ngrams, 97, 25, 3, 7)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = sorted(map(tuple, importance_resampling.resample(docs, none, min_words=1, percent=100).collect()))
    assert [(r[0], r[1], r[4]) for r in got] == [(1, 3, 1), (2, 0, None)]
    assert importance_resampling.resample(docs.limit(0), none).collect() == []


# --- operator 12 -----------------------------------------------------------


def brute_mine(rows, every):
    """Of (id, label, vector), all of which take part."""
    q = [(i, x, [math.floor(256 * c) for c in v]) for i, x, v in rows]
    out = Counter()
    for a, (i, label, v) in enumerate(q):
        if i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), j, own == label) for b, (j, own, w) in enumerate(q) if b != a and len(w) == len(v)))
        for p, pid, _ in [s for s in scored if s[2]][:5]:
            hard = [s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out.update((i, pid, rank + 1, nid, -p, -n) for rank, (n, nid, _) in enumerate(hard))
    return out


def some_vectors(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(i % 3), (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(i, i % 2, rng.normal(size=3).round(1).tolist()) for i in range(400, 460)]  # another length, many ties
    rows += [(i, 7, [0.0] * 8) for i in range(460, 480)] + [(500, 9, [1.0] * 8)]  # zeros; a label of its own
    rows += [rows[0], rows[0], rows[20], (20, 5, rows[21][2]), (-40, 1, rows[1][2])]  # repeated rows, an id used twice
    return rows


ODD = [(None, 1, [1.0] * 8), (2000, None, [1.0] * 8), (2020, 1, None), (2040, 1, []), (2060, 1, [float("nan")] * 8),
       (2080, 1, [float("inf")] + [0.0] * 7), (2100, 1, [None] + [0.0] * 7), (2120, 1, [1e300] * 8)]


@pytest.mark.parametrize("block_rows, round_bytes", [(1024, 16_000_000), (16, 400)])
def test_mining_matches_brute_force(spark, monkeypatch, block_rows, round_bytes):
    if block_rows < 100:
        monkeypatch.setattr(hard_negatives, "SCORES", 50)
        monkeypatch.setattr(hard_negatives, "PAIRS", 20)
        monkeypatch.setattr(hard_negatives, "FOLDER_BLOCKS", 2)
    rows = some_vectors()
    df = spark.createDataFrame([(*r, 1, "s") for r in rows + ODD], "vec_id long, label int, embedding array<double>, dim int, salt string")
    got = hard_negatives.mine(df.repartition(3), every=20, block_rows=block_rows, round_bytes=round_bytes)
    assert Counter(map(tuple, got.collect())) == brute_mine(rows, 20)


def test_mining_of_long_integers_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, (rng.integers(-2**20, 2**20, 6).astype(float)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    assert Counter(map(tuple, hard_negatives.mine(df, every=10).collect())) == brute_mine(rows, 10)


def test_mining_of_empty_tables(spark):
    shape = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(1, 1, [1.0])], [(100, 1, [1.0])], [(100, 1, [1.0]), (200, 1, [1.0])]):
        got = hard_negatives.mine(spark.createDataFrame(rows, shape))
        assert got.collect() == [] and ", ".join(f"{c} {t}" for c, t in got.dtypes) == hard_negatives.MINED


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hard_negatives.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_zone_maps_bound_products_and_skip_folders(spark, tmp_path):
    rng = np.random.default_rng(2)
    m = rng.integers(-300, 300, (50, 12))
    a = hard_negatives.Anchors(*[np.arange(9)] * 3, rng.integers(-300, 300, (9, 12)), np.full(9, hard_negatives.NONE))
    low, high = a.bounds(m.min(0)[None], m.max(0)[None])
    scores = a.vectors @ m.T
    assert (low <= scores.min(1)[:, None]).all() and (scores.max(1)[:, None] <= high).all()
    # clusters far apart: most folders are not read for an anchor's positives
    centres = np.eye(16) * 10
    rows = [(i, i % 16, (centres[i % 16] + 0.1 * rng.normal(size=16)).tolist()) for i in range(3200)]
    vectors = hard_negatives.integer_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), "vec_id", "label", "embedding")
    blocks = hard_negatives.build_blocks(vectors, f"{tmp_path}/t", block_rows=10)
    table, rounds = hard_negatives.anchor_rows(blocks, 1600, 5, f"{tmp_path}/t")
    assert rounds == 1 and table.count() == 2
    anchors = hard_negatives.one_round(table.drop("round").toArrow())
    needed = hard_negatives.needed_folders(blocks, anchors, hard_negatives.Positives(5), f"{tmp_path}/n").where("pairs > 0").count()
    assert 0 < needed <= 0.2 * blocks.select("folder").distinct().count()


# --- operator 13 -----------------------------------------------------------


def test_levels_minimise_the_sum_of_squares():
    r = random.Random(3)
    for _ in range(20):
        capacity = r.randrange(2, 40)
        levels, counts = sum_of_squares.Levels(capacity), [0] * (capacity + 1)
        for _ in range(200):
            size = r.randrange(1, capacity)

            def after(h):
                n = list(counts)
                n[h] -= h > 0
                n[h + size] += h + size < capacity
                return sum(x * x for x in n)

            can = [h for h in range(capacity - size + 1) if h == 0 or counts[h]]
            want = min(can, key=lambda h: (after(h), -h))
            assert levels.choose(size) == want
            full = levels.place((1, 0, size, b"\0" * 4 * size))
            counts[want] -= want > 0
            counts[want + size] += want + size < capacity
            assert (full is not None) == (want + size == capacity)
            assert [len(w) for w in levels.windows] == counts[:capacity]


@pytest.mark.parametrize("capacity, open_tokens", [(4096, 8_000_000), (64, 100), (1, 1), (100, 1_000)])
def test_packing_places_every_token_once(spark, capacity, open_tokens):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["word", "Two.", "déjà", "x1"], k=r.randrange(0, 400)))) for i in range(150)]
    rows += [(300, "x " * 9_000), (301, None), (302, ""), (5, "twice"), (5, "twice"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(a, b, 9, "z") for a, b in rows], "doc_id long, text string, length int, offset string").repartition(3)
    got = sum_of_squares.pack(docs, capacity, open_tokens=open_tokens).collect()
    places, parts = defaultdict(list), defaultdict(list)
    for p in got:
        places[p.sequence_id].append((p.offset, p.length))
        parts[p.doc_id].append(p)
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:]))
    sizes = [sum(n for _, n in p) for p in places.values()]
    assert all(n == capacity or n < capacity and n & (n - 1) == 0 for n in sizes)
    encode = tokens.encoder(sum_of_squares.VOCABULARY)
    for i, text in rows:
        if (i, text) in rows[:150] + rows[150:153] and i != 5:
            ids = next(iter(encode([text or ""]))) + b"\2\0\0\0"
            mine = sorted(parts[i], key=lambda p: p.start)
            assert [p.start for p in mine] == np.cumsum([0, *(p.length for p in mine)])[:-1].tolist()
            assert sum(p.length for p in mine) == len(ids) // 4 == mine[0].doc_tokens
            assert all(p.ids_crc32 == zlib.crc32(ids[4 * p.start:4 * (p.start + p.length)]) for p in mine)
    twice = len(next(iter(encode(["twice"])))) // 4 + 1
    assert sum(p.length for p in parts[5]) == len(next(iter(encode([rows[5][1]])))) // 4 + 1 + 2 * twice
    assert sum(p.length for p in parts[None]) == len(next(iter(encode(["no id"])))) // 4 + 2


def test_packing_holds_few_open_tokens_and_cuts_little():
    r = random.Random(5)
    mixed = [int(r.lognormvariate(6, 1)) + 1 for _ in range(8000)]
    large = [r.choice([3000, 2500, 100]) for _ in range(4000)]  # most cannot share a window
    for sizes, bound, most in ((mixed, 8_000_000, 0.2), (mixed, 100_000, 1), (large, 100_000, 1.01)):
        packer, windows = sum_of_squares.Packer(4096, bound), []
        for i, n in enumerate(sizes):
            windows += packer.add(i, b"\0\0\0\0" * n)
            assert packer.levels.tokens <= bound
        windows += packer.end()
        assert sum(len(p[3]) // 4 for w in windows for p in w) == sum(sizes)
        assert sum(len(w) for w in windows) - sum(-(-n // 4096) for n in sizes) <= most * len(windows)


def test_packing_of_an_empty_table(spark):
    got = sum_of_squares.pack(spark.createDataFrame([], "doc_id long, text string"))
    assert got.collect() == [] and [c for c, _ in got.dtypes] == [c.split()[0] for c in sum_of_squares.PACKED.split(", ")]
