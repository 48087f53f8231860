"""Operator 6: approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  Each block of vectors
posts (vector, place of the pivot) under every such pivot, an inverted file.  A
query walks the lists of its own nearest pivots and adds up the footrule
distance between its order and that of every vector posted there; vectors
without a common pivot keep the largest distance.  The nearest by footrule are
reranked by their true inner product: a matrix product, whose last bits depend
on its shape, names all rows that may be among the best, and these are scored
by ``inner``, whose sums run in the order of the components.  So equal vectors
have equal scores wherever they lie, and ties go by id.

Pivots are a bounded sample: the ``pivots`` vectors of each length with the
smallest hash of their id.  All vectors are indexed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm import vector_blocks as vb

PIVOTS = 256
#: Nearest pivots that represent a vector.
PREFIX = 64
#: Part of a block that is reranked, with all ties at its edge.
RERANKED = 0.3
#: Queries whose products with a block are taken at once.
TOGETHER = 64


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed from the first component to the last."""
    out = np.zeros(len(vectors))
    for j, x in enumerate(query):
        out += vectors[:, j] * x
    return out


def candidates(near: np.ndarray, error: float, k: int) -> np.ndarray:
    """Rows that may be among the k best, if ``near`` is off by ``error`` at most."""
    if len(near) <= k or not np.isfinite(error):
        return np.arange(len(near))
    return np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k] - 2 * error)


class PermutationIndex:
    """Inner-product search over blocks; see :class:`vector_blocks.Searcher`."""

    score = float

    def __init__(self, pivots: dict[int, np.ndarray], prefix: int = PREFIX, reranked: float = RERANKED):
        self.pivots, self.prefix, self.reranked = pivots, prefix, reranked

    def orders(self, vectors: np.ndarray) -> np.ndarray:
        """Each vector's nearest pivots, nearest first."""
        pivots = self.pivots[vectors.shape[1]]
        scale = np.abs(pivots).max(axis=1, keepdims=True)  # by angle: scaled first, so that squares stay finite
        unit = pivots / scale / np.linalg.norm(pivots / scale, axis=1, keepdims=True)
        near = (vectors / np.abs(vectors).max(axis=1, keepdims=True)) @ unit.T
        return np.argsort(-near, axis=1, kind="stable")[:, :self.prefix].astype(np.int32)

    def build(self, ids: np.ndarray, vectors: np.ndarray) -> dict:
        orders = self.orders(vectors)
        n, prefix = orders.shape
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        lists = np.searchsorted(orders.ravel()[by_pivot], np.arange(len(self.pivots[vectors.shape[1]]) + 1))
        return {"ids": ids, "vectors": vectors, "orders": orders, "lists": lists, "longest": np.linalg.norm(vectors, axis=1).max(),
                "rows": (by_pivot // prefix).astype(np.int32), "places": (by_pivot % prefix).astype(np.int32)}

    def ask(self, block: dict, rows: np.ndarray) -> dict:
        return {"ids": block["ids"][rows], "vectors": block["vectors"][rows], "orders": block["orders"][rows]}

    def footrule(self, block: dict, order: np.ndarray) -> np.ndarray:
        """Of one query's order to those of all vectors of the block; a pivot
        outside an order counts as just behind its end."""
        prefix, lists = len(order), block["lists"]
        posted = [slice(lists[p], lists[p + 1]) for p in order]
        rows = np.concatenate([block["rows"][s] for s in posted])
        theirs = np.concatenate([block["places"][s] for s in posted])
        mine = np.repeat(np.arange(prefix, dtype=np.int32), lists[order + 1] - lists[order])
        saved = prefix - np.maximum(mine, theirs)  # half of (prefix - mine) + (prefix - theirs) - |mine - theirs|
        return prefix * (prefix + 1) - 2 * np.bincount(rows, saved, minlength=len(block["ids"]))

    def best(self, block: dict, queries: dict, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(block["ids"])
        ids = np.full((len(own), k), -1, np.int64)
        scores = np.full((len(own), k), -np.inf)
        take = min(n, max(k + 1, int(np.ceil(self.reranked * n))))
        for q, order in enumerate(queries["orders"]):
            if q % TOGETHER == 0:
                near = queries["vectors"][q:q + TOGETHER] @ block["vectors"].T
            far = self.footrule(block, order)
            rows = np.flatnonzero(far <= np.partition(far, take - 1)[take - 1])
            rows = rows[rows != own[q]]
            query = queries["vectors"][q]
            # any order of summing n products errs by less than n units of rounding of the sum of their sizes
            error = 4 * len(query) * np.finfo(float).eps * block["longest"] * np.linalg.norm(query)
            rows = rows[candidates(near[q % TOGETHER, rows], error, k)]
            exact = inner(block["vectors"][rows], query)
            got = np.lexsort((block["ids"][rows], -exact))[:k]
            ids[q, :len(got)], scores[q, :len(got)] = block["ids"][rows[got]], exact[got]
        return ids, scores


def sample_pivots(vectors: DataFrame, pivots: int = PIVOTS, seed: int = 17) -> dict[int, np.ndarray]:
    """At most ``pivots`` vectors per vector length."""
    out = {}
    for r in vectors.groupBy(F.size("vec").alias("dim")).count().collect():
        rows = (vectors.where(F.size("vec") == r["dim"]).select("vec", F.xxhash64(F.lit(seed), "id", "vec").alias("h"))
                .orderBy("h").limit(pivots).collect())
        out[r["dim"]] = np.array([x["vec"] for x in rows])
    return out


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
            prefix: int = PREFIX, pivots: int = PIVOTS, reranked: float = RERANKED) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row whose
    id is divisible by ``every``, by inner product, ties to the smaller id.

    Rows with a null id, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part.  A query has candidates of its own
    length only.  Repeated rows are candidates of each other and queries of
    their own.  An empty table gives an empty result."""
    ok = vb.finite_vectors(vectors, vec_id, vector, zeros=False)
    index = PermutationIndex(sample_pivots(ok, pivots), prefix, reranked)
    return vb.search(vb.build_blocks(ok, index), index, lambda ids: ids % every == 0, k)
