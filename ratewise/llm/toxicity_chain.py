"""Operator 3: toxicity by a classifier chain.

Categories are predicted in turn.  Each has a linear (logistic) model over the
words of a text and the logits of the categories before it.  For training, a
category's logits come from folds that did not see the document, so that later
models learn how far earlier ones can be trusted.

A text's features are which of a few hundred telling words and word beginnings
it holds, how dense these are, and its length; they are taken from the whole
text, and one hit counts in a text of any length.  Fitting uses a bounded,
documented sample of labelled documents (the ``SAMPLE`` smallest hashes of
their ids), and all words of these.  Their features are counted by Spark, and
only the telling ones, with each document's hits of them and number of words,
reach the driver.  Scoring reads every text once, in the tasks that scan it,
without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.sinks.io import materialize

#: Labelled documents that a model is fitted on at most.
SAMPLE = 5000
#: Words and word beginnings of a model, and folds of the chain.
FEATURES, FOLDS = 300, 4
#: Lengths of word beginnings.
STEMS = (4, 5, 6, 7)
#: Tasks that look for telling features, each among its share of all, and files of the sample.
PARTS, FILES = 16, 64
#: Counts that a task holds before it hands them on.
HELD = 200_000
#: Texts whose features are held at a time when scoring.
ROWS = 500

#: The chain: name of each category and its truth in terms of the labels.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("severe", "toxic = 1 AND quality = 0"))

_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in STEMS if len(word) > n)]


def text_features(found: set[str]) -> Iterator[str]:
    """The features of a text's words, each once.  In sorted order equal
    beginnings follow each other, so that no second set is held."""
    last = dict.fromkeys(STEMS, "")
    for w in sorted(found):
        yield w
        for n in STEMS:
            if len(w) > n and w[:n] != last[n]:
                last[n] = w[:n]
                yield "^" + w[:n]


def _gain(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """How much a feature says for a category that ``a`` of its holders have and ``b`` have not."""
    p, q, m = (a + 0.5) / n1, (b + 0.5) / n0, (a + b + 1) / (n1 + n0)
    return np.where((a >= 3) & (p > q), a * np.log(p / m) + b * np.log(q / m), -np.inf)


def _first(gain: np.ndarray, most: int) -> np.ndarray:
    order = np.argsort(-gain, kind="stable")[:most]
    return order[np.isfinite(gain[order])]


def _any_telling(counts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The features that are among the ``most`` telling ones of any category,
    over all folds or all but one.  ``counts``: per feature and fold, the
    documents that hold it, and those of each category; ``sizes``: the same of
    all documents."""
    taken = np.zeros(len(counts), bool)
    for out in range(len(sizes) + 1):
        use = np.arange(len(sizes)) != out
        c, n = counts[:, use].sum(axis=1), sizes[use].sum(axis=0)
        for k in range(1, len(n)):
            taken[_first(_gain(c[:, k], c[:, 0] - c[:, k], n[k] + 1, n[0] - n[k] + 1), most)] = True
    return np.flatnonzero(taken)


def _design(hits: np.ndarray, n_words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows of the linear models: hits, length, density, logits so far, 1."""
    density = 10 * hits.sum(axis=1) / (n_words + 5)
    return np.column_stack([hits, np.log1p(n_words), density, before, np.ones(len(hits))])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 15) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is free."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Encoded:
    """Documents as numbered features, row after row."""

    names: list[str]
    n_words: np.ndarray
    row: np.ndarray
    feature: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str]) -> Encoded:
        """``texts``: each document's distinct words, joined by spaces."""
        number: dict[str, int] = {}
        known: dict[str, list[int]] = {}
        rows = []
        for t in texts:
            found: set[int] = set()
            for w in t.split():
                if w not in known:
                    known[w] = [number.setdefault(f, len(number)) for f in word_features(w)]
                found.update(known[w])
            rows.append(np.fromiter(found, np.int32, len(found)))
        sizes = [len(r) for r in rows]
        return cls(list(number), np.array([len(t.split()) for t in texts], float), np.repeat(np.arange(len(rows)), sizes),
                   np.concatenate([np.empty(0, np.int32), *rows]))

    def telling(self, docs: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """The features whose presence in ``docs`` says most for y = 1."""
        truth = np.full(len(self.n_words), -1)
        truth[docs] = y
        count = lambda t: np.bincount(self.feature[truth[self.row] == t], minlength=len(self.names))
        return _first(_gain(count(1), count(0), y.sum() + 1, (1 - y).sum() + 1), most)

    def hits(self, features: np.ndarray) -> np.ndarray:
        """0/1 of each document and each of ``features``."""
        at = np.full(len(self.names) + 1, -1)
        at[features] = np.arange(len(features))
        out = np.zeros((len(self.n_words), len(features)))
        col = at[self.feature]
        out[self.row[col >= 0], col[col >= 0]] = 1
        return out


@dataclass
class Link:
    """One model of the chain."""

    name: str
    features: list[str]
    weights: np.ndarray  # of the columns of _design
    threshold: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def logits(self, hits: Sequence[np.ndarray], n_words: np.ndarray) -> np.ndarray:
        """Of all categories, for the hits of each link's features."""
        out = np.empty((len(n_words), 0))
        for link, h in zip(self.links, hits, strict=True):
            out = np.column_stack([out, np.clip(_design(h, n_words, out) @ link.weights, -30, 30)])
        return out


def fit_chain(texts: Sequence[str] | Encoded, truths: Sequence[tuple[str, np.ndarray]], most: int = FEATURES, folds: int = FOLDS) -> Chain:
    """``texts``: each document's distinct words, joined by spaces, or its features (at least all
    that ``_any_telling`` finds); ``truths``: (category, 0/1 per document) in chain order.  A category that has fewer than ``folds``
    documents on either side gets a constant model and rejects nothing."""
    docs = texts if isinstance(texts, Encoded) else Encoded.of(texts)
    n = len(docs.n_words)
    fold = np.arange(n) % folds
    before = np.empty((n, 0))
    chain = Chain()
    for name, y in truths:
        y = y.astype(float)
        if min(y.sum(), n - y.sum()) < folds:
            prior = math.log((y.sum() + 1) / (n - y.sum() + 1))
            chain.links.append(Link(name, [], np.array([0.0] * (2 + before.shape[1]) + [prior]), 2.0))
            before = np.column_stack([before, np.full(n, prior)])
            continue
        unseen = np.empty(n)
        for k in range(folds):
            new = fold == k
            x = _design(docs.hits(docs.telling(np.flatnonzero(~new), y[~new], most)), docs.n_words, before)
            unseen[new] = x[new] @ _fit(x[~new], y[~new])
        unseen = np.clip(unseen, -30, 30)
        chosen = docs.telling(np.arange(n), y, most)
        w = _fit(_design(docs.hits(chosen), docs.n_words, before), y)
        chain.links.append(Link(name, [docs.names[i] for i in chosen], w, _threshold(1 / (1 + np.exp(-unseen)), y)))
        before = np.column_stack([before, unseen])
    return chain


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability cut with the best F1 out of fold."""
    cuts = np.arange(0.2, 0.81, 0.05)
    f1 = [2 * ((p >= c) & (y == 1)).sum() / ((p >= c).sum() + y.sum()) for c in cuts]
    best = np.flatnonzero(np.isclose(f1, max(f1)))
    return float(cuts[best[len(best) // 2]])


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str]] = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """The chain fitted on a bounded sample of ``docs`` (doc_id, text) that
    ``labels`` (doc_id, quality, toxic) covers.  Conflicting labels of an id
    count as true; null labels as false; texts of one id are one document."""
    truth = [F.max(F.coalesce(F.expr(e), F.lit(False)).cast("int")).alias(n) for n, e in categories]
    chosen = (labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*truth)
              .withColumn("h", F.xxhash64(F.lit(3), "doc_id")).orderBy("h", "doc_id").limit(sample))
    names = [n for n, _ in categories]
    texts = (docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # ``sample`` rows
             .groupBy("h").agg(F.min("text").alias("text"), *[F.max(n).alias(n) for n in names]))
    texts = materialize(texts.repartition(FILES, "h"), "toxicity-sample")
    known = texts.select("h", *names).toPandas().sort_values("h")  # ``sample`` rows
    truths = [(n, known[n].to_numpy()) for n in names]
    docs_found = encode_sample(texts, known["h"].to_numpy(), [y for _, y in truths])
    return fit_chain(docs_found, truths)


def encode_sample(texts: DataFrame, ids: np.ndarray, truths: Sequence[np.ndarray], most: int = FEATURES, folds: int = FOLDS) -> Encoded:
    """The telling features of ``texts`` (h, text), whose ``ids`` and
    ``truths`` are given in order, and each text's hits and number of words.
    Features are counted per fold and truth of their texts, in Spark."""
    if not len(ids):
        return Encoded.of([])
    fold = np.arange(len(ids)) % folds
    kinds, kind = np.unique(np.column_stack([fold, *truths]), axis=0, return_inverse=True)
    kind_of = dict(zip(ids.tolist(), kind.ravel().tolist(), strict=True))
    sizes = np.array([[(fold == k).sum(), *[int(y[fold == k].sum()) for y in truths]] for k in range(folds)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([f for f, _ in held], pa.string()), pa.array([k for _, k in held], pa.int32()),
                                              pa.array(held.values(), pa.int64())], names=["feature", "kind", "n"])
            held.clear()
            return out

        for batch in batches:
            for h, t in zip(batch.column(0), batch.column(1), strict=True):
                k = kind_of[h.as_py()]
                for f in text_features(words(t.as_py())):
                    held[f, k] += 1
                    if len(held) >= HELD:
                        yield batch_of()
        yield batch_of()

    def holders(k: int, column: int) -> Column:
        """Of the texts of fold k, all or (column > 0) those of a category."""
        of = [i for i, x in enumerate(kinds) if x[0] == k and (not column or x[column])]
        return F.sum(F.when(F.col("kind").isin(of), F.col("n")).otherwise(0)).cast("long")

    def telling(names: list[str], counts: list[list[int]]) -> tuple[list[str], list[list[int]]]:
        order = sorted(range(len(names)), key=names.__getitem__)  # equal gains: by name
        c = np.array([counts[i] for i in order], np.int64).reshape(len(order), folds, len(truths) + 1)
        kept = [order[i] for i in _any_telling(c, sizes, most)]
        return [names[i] for i in kept], [counts[i] for i in kept]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        counts: list[list[int]] = []
        for batch in batches:
            names, counts = telling(names + batch.column(0).to_pylist(), counts + batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.list_(pa.int64()))], names=["feature", "counts"])

    found = (texts.select("h", "text").mapInArrow(count, "feature string, kind int, n bigint").groupBy("feature")
             .agg(F.array(*[holders(k, c) for k in range(folds) for c in range(len(truths) + 1)]).alias("counts"))
             .coalesce(PARTS).mapInArrow(best, "feature string, counts array<bigint>").toPandas())
    names, _ = telling(list(found["feature"]), [list(c) for c in found["counts"]])
    number = {f: i for i, f in enumerate(names)}

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hits = [], []
            for t in batch.column(1):
                s = words(t.as_py())
                sizes.append(len(s))
                hits.append([number[f] for f in text_features(s) if f in number])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.int32()))],
                                             names=["h", "n_words", "hits"])

    rows = texts.select("h", "text").mapInArrow(hit, "h bigint, n_words bigint, hits array<int>").toPandas().sort_values("h")
    lengths = [len(x) for x in rows["hits"]]
    return Encoded(names, rows["n_words"].to_numpy(float), np.repeat(np.arange(len(rows)), lengths),
                   np.concatenate([np.empty(0, np.int32), *[np.array(x, np.int32) for x in rows["hits"]]]))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with p_<category> for each category and ``rejected``: whether
    any category but the quality one reaches its threshold.  All rows and
    columns of ``docs`` are kept (columns of these names are replaced); null
    and empty texts have no words and the models' prior."""
    index: dict[str, list[tuple[int, int]]] = {}
    for k, link in enumerate(chain.links):
        for j, f in enumerate(link.features):
            index.setdefault(f, []).append((k, j))
    names = [f"p_{link.name}" for link in chain.links]
    judged = [k for k, link in enumerate(chain.links) if link.name != "low_quality"]
    cuts = np.array([link.threshold for link in chain.links])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple] = {}  # what a word hits; emptied when full

        def hit(word: str) -> tuple:
            if len(seen) > 100_000:
                seen.clear()
            out = seen[word] = tuple(x for f in word_features(word) for x in index.get(f, ()))
            return out

        def judged_rows(texts: pd.Series) -> np.ndarray:
            found = [np.zeros((len(texts), len(link.features))) for link in chain.links]
            n_words = np.zeros(len(texts))
            for i, t in enumerate(texts):  # the words of one text are held at a time, not those of a batch
                s = words(t)
                n_words[i] = len(s)
                for w in s:
                    for k, j in seen[w] if w in seen else hit(w):
                        found[k][i, j] = 1
            return 1 / (1 + np.exp(-chain.logits(found, n_words)))

        for batch in batches:
            parts = [judged_rows(batch.iloc[i:i + ROWS]) for i in range(0, len(batch), ROWS)]
            p = np.concatenate([np.empty((0, len(names))), *parts])
            rejected = (p >= cuts)[:, judged].any(axis=1)
            yield pd.DataFrame({n: p[:, i] for i, n in enumerate(names)} | {"rejected": rejected})

    kind = ", ".join(f"{n} double" for n in names) + ", rejected boolean"
    judge = F.pandas_udf(run, kind)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*names, "rejected")]
    out = docs.select(*keep, judge(F.col("text").cast("string")).alias("__judged"))
    return out.select(*keep, *[F.col(f"__judged.{n}").alias(n) for n in (*names, "rejected")])


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the category probabilities and ``rejected`` of every row of
    ``docs``.  Repeated rows come out alike.  Without labels nothing is
    rejected; an empty table gives an empty result."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", *[c for c in scored.columns if c.startswith("p_")], "rejected")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    return score(docs, train(docs, labels)).where("NOT rejected").select(docs.columns)
