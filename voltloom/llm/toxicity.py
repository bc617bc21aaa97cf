"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each later model sees the earlier
categories' probabilities beside the document's own features. In training those
probabilities are out of fold: a row's come from a model that never saw it, so
the later model learns from inputs as uncertain as the ones it will meet.

Features are the document's distinct words and, for the beginnings of words,
whether one, two or three distinct words share them (hashes, so that
collisions do not matter), of which those most associated with a category are
kept, and four ratios of the whole text. Shared beginnings let a stem count in
forms that the labelled rows never show, and tell its repeated use from chance.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.durable import small_batches

#: Labelled rows used for training at most (the documented bound of the sample).
MAX_TRAINING = 8_000
#: Words and beginnings kept for a category at most, and lengths of beginnings.
MAX_WORDS = 1_024
STEMS = (4, 5, 6)
#: Words sharing a beginning are told apart up to this number.
MAX_SHARED = 3
#: Folds of the out-of-fold predictions.
FOLDS = 3
#: Probability of the last category from which a document is toxic.
THRESHOLD = 0.5
#: The categories in the order of the chain, with the labels they come from.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
#: Texts that a task takes apart at a time.
SLICE = 256
_WORD = re.compile(r"[^\W\d_]+")
_DENSE = 4


def words_of(text: str) -> tuple[set[str], tuple[float, ...]]:
    """The distinct words of a whole text in lower case, and its four ratios."""
    found = _WORD.findall(text.lower())
    distinct = set(found)
    n, letters = len(found), sum(map(len, found))
    return distinct, (np.log1p(n) / 10, len(distinct) / max(1, n), letters / max(1, len(text)), min(2.0, letters / max(1, n) / 10))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few texts, so that what a task holds as Python strings is bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def hash_of(form: str) -> int:
    return xxhash.xxh32_intdigest(form.encode("utf-8", "surrogatepass"))


def stems_of(word: str) -> list[str]:
    return [word[:k] for k in STEMS if len(word) >= k]


def features_of(words: set[str]) -> np.ndarray:
    """Hashes of a document's words and shared beginnings, ascending."""
    shared = Counter(s for w in words for s in stems_of(w))
    forms = [*words, *[f"{s}^{k}" for s, n in shared.items() for k in range(1, min(n, MAX_SHARED) + 1)]]
    return np.unique(np.array([hash_of(f) for f in forms], np.uint32))


class Rows:
    """Sparse 0/1 rows with a few dense columns and a constant."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n_cols: int, dense: np.ndarray):
        self.rows, self.cols, self.n_cols = rows, cols, n_cols
        self.dense = np.hstack([dense, np.ones((len(dense), 1))])
        self.width = n_cols + self.dense.shape[1]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], len(self.dense)) + self.dense @ w[self.n_cols :]

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.cols, r[self.rows], self.n_cols), self.dense.T @ r])

    def take(self, mask: np.ndarray) -> Rows:
        place = np.cumsum(mask) - 1
        keep = mask[self.rows]
        return Rows(place[self.rows[keep]], self.cols[keep], self.n_cols, self.dense[mask, :-1])

    def beside(self, column: np.ndarray) -> Rows:
        """With a dense column more."""
        return Rows(self.rows, self.cols, self.n_cols, np.hstack([self.dense[:, :-1], column[:, None]]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(x: Rows, y: np.ndarray, l2: float = 0.5, steps: int = 12, inner: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps whose systems are solved by conjugate gradients."""
    w = np.zeros(x.width)
    penalty = np.full(x.width, l2)
    penalty[-1] = 1e-6  # the constant
    if not len(y) or y.min() == y.max():  # one class only: nothing to tell apart
        w[-1] = 6.0 if len(y) and y[0] > 0 else -6.0
        return w
    for _ in range(steps):
        p = sigmoid(x.dot(w))
        g = x.tdot(p - y) + penalty * w
        s = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -g
        d, rr = r.copy(), float(r @ r)
        for _ in range(inner):
            if rr < 1e-10:
                break
            hd = x.tdot(s * x.dot(d)) + penalty * d
            a = rr / float(d @ hd)
            step += a * d
            r -= a * hd
            new = float(r @ r)
            d, rr = r + new / rr * d, new
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Chain:
    """A trained chain: the words kept, and a weight vector for each category."""

    names: tuple[str, ...]
    column: dict[int, int]
    weights: list[np.ndarray]

    def probabilities(self, x: Rows) -> np.ndarray:
        found = []
        for w in self.weights:
            found.append(sigmoid(x.dot(w)))
            x = x.beside(found[-1])
        return np.array(found).T


def select_words(at: np.ndarray, rows: np.ndarray, n_words: int, labels: np.ndarray, max_words: int = MAX_WORDS) -> np.ndarray:
    """The words whose share of a category differs beyond chance.

    ``at`` and ``rows`` are the word and the row of each occurrence; labels:
    rows x categories, NaN unknown. A word is kept if its log-likelihood ratio
    against the category is above what chance would reach among all the words
    tried, so that common words of the training rows alone do not get in.
    """
    tried = max(10, int((np.bincount(at, minlength=n_words) > 0).sum()))
    chosen = []
    for y in labels.T:
        known = ~np.isnan(y)
        n, pos = known.sum(), np.nansum(y)
        if not n or pos in (0, n):
            continue
        hits, docs = (np.bincount(at[mask[rows]], minlength=n_words) for mask in (known & (y > 0), known))
        miss, rate = docs - hits, pos / n
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(hits > 0, hits * np.log(hits / (docs * rate)), 0) + np.where(miss > 0, miss * np.log(miss / (docs * (1 - rate))), 0))
        ratio = np.where(docs > 0, ratio, 0)
        ratio[ratio < 2 * np.log(tried)] = 0
        best = np.argsort(-ratio, kind="stable")[:max_words]
        chosen.append(best[ratio[best] > 0])
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def train_chain(docs: list[tuple[np.ndarray, tuple[float, ...]]], labels: np.ndarray, names: tuple[str, ...], folds: int = FOLDS) -> Chain:
    """Train on documents given by word hashes and ratios; labels: rows x categories, 0, 1 or NaN (unknown)."""
    n = len(docs)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(h) for h, _ in docs]) if n else np.zeros(0, np.int32)
    hashes = np.concatenate([h for h, _ in docs]) if n else np.zeros(0, np.uint32)
    dense = np.array([d for _, d in docs]).reshape(n, _DENSE)
    docs.clear()  # what is left of them stands in the arrays
    every = np.unique(hashes)
    at = np.searchsorted(every, hashes).astype(np.int32)
    del hashes

    def described(words: np.ndarray) -> Rows:
        place = np.full(len(every), -1, np.int32)
        place[words] = np.arange(len(words))
        kept = np.flatnonzero(place[at] >= 0)
        return Rows(rows[kept].astype(np.int64), place[at[kept]].astype(np.int64), len(words), dense)

    words = select_words(at, rows, len(every), labels)
    x = described(words)
    fold = np.arange(n) % folds
    parts = []
    for k in range(folds if labels.shape[1] > 1 else 0):
        # a fold's rows take no part in choosing the words by which they are judged
        others = (fold != k)[rows]
        parts.append(described(select_words(at[others], rows[others], len(every), np.where((fold != k)[:, None], labels, np.nan))))
    weights = []
    for category, y in enumerate(labels.T):
        known = ~np.isnan(y)
        weights.append(fit_linear(x.take(known), y[known]))
        if category + 1 < labels.shape[1]:
            unseen = np.zeros(n)
            for k, part in enumerate(parts):
                model = fit_linear(part.take(known & (fold != k)), y[known & (fold != k)])
                unseen[fold == k] = sigmoid(part.dot(model))[fold == k]
            x, parts = x.beside(unseen), [part.beside(unseen) for part in parts] if category + 2 < labels.shape[1] else []
    return Chain(names, {int(every[w]): k for k, w in enumerate(words)}, weights)


def fit_on_labels(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chain: tuple[tuple[str, str], ...] = CHAIN, max_training: int = MAX_TRAINING) -> Chain:
    """Train the chain on the labelled documents, on ``max_training`` rows of smallest id hash at most.

    The labels of the sample (its bound is the parameter) are broadcast to the
    documents, so that no text is shuffled. Equal texts count once. A document or
    text that has several labels of a category has the largest of them. Rows
    without text, id or any label are left out; without any rows the chain finds
    nothing toxic.
    """
    small_batches(docs.sparkSession)
    wanted = labels.select(F.col(id_col).alias("__id"), *[F.expr(e).cast("double").alias(f"__y{k}") for k, (_, e) in enumerate(chain)])
    wanted = wanted.filter(F.col("__id").isNotNull() & F.coalesce(*[F.col(f"__y{k}") for k in range(len(chain))]).isNotNull())
    wanted = wanted.groupBy("__id").agg(*[F.max(f"__y{k}").alias(f"__y{k}") for k in range(len(chain))])
    wanted = wanted.orderBy(F.xxhash64("__id"), "__id").limit(max_training)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull()).join(F.broadcast(wanted), "__id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashed, ratios, same = [], [], []
            for text in batch.column(1).to_pylist():
                found, dense = words_of(text)
                hashed.append(features_of(found).tobytes())
                ratios.append(list(dense))
                same.append(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(hashed, pa.binary()), pa.array(ratios, pa.list_(pa.float64())), pa.array(same, pa.int64()), *batch.columns[2:]], names=["words", "ratios", "same", *batch.schema.names[2:]])

    known = ", ".join(f"__y{k} double" for k in range(len(chain)))
    sample = rows.mapInArrow(features, f"words binary, ratios array<double>, same long, {known}")
    sample = sample.groupBy("same").agg(F.first("words").alias("words"), F.first("ratios").alias("ratios"), *[F.max(f"__y{k}").alias(f"__y{k}") for k in range(len(chain))])
    sample = sample.toArrow().combine_chunks().sort_by("same")
    labelled = np.array([sample.column(f"__y{k}").to_numpy() for k in range(len(chain))], float).reshape(len(chain), sample.num_rows).T
    found = [(np.frombuffer(w.as_buffer(), np.uint32), tuple(r.as_py())) for w, r in zip(sample.column("words"), sample.column("ratios"), strict=True)]
    del sample  # the hashes alone live on, until they are put into one array
    return train_chain(found, labelled, tuple(n for n, _ in chain))


def judge(model: Chain) -> Callable[[list[str | None]], np.ndarray]:
    """A function from whole texts to their probabilities, a column for each category; for one task."""
    column, width = model.column, len(model.column)
    known: dict[str, tuple[int, ...]] = {}  # a beginning's columns by the number of words that share it
    memory: dict[str, tuple[int, tuple[tuple[int, ...], ...]]] = {}  # a word's column and its beginnings' columns

    def look_up(word: str) -> tuple[int, tuple[tuple[int, ...], ...]]:
        if len(memory) > 100_000:
            memory.clear()
            known.clear()
        stems = []
        for s in stems_of(word):
            if s not in known:
                known[s] = tuple(column.get(hash_of(f"{s}^{k}"), -1) for k in range(1, MAX_SHARED + 1))
            if max(known[s]) >= 0:
                stems.append(known[s])
        memory[word] = (column.get(hash_of(word), -1), tuple(stems))
        return memory[word]

    def probabilities(texts: list[str | None]) -> np.ndarray:
        rows, cols, dense = [], [], []
        for k, text in enumerate(texts):
            found, ratios = words_of(text or "")
            dense.append(ratios)
            mine: list[int] = []
            shared: Counter[tuple[int, ...]] = Counter()
            for word in found:
                at, stems = memory.get(word) or look_up(word)
                if at >= 0:
                    mine.append(at)
                if stems:
                    shared.update(stems)
            for stem, n in shared.items():
                mine += [c for c in stem[:n] if c >= 0]
            rows += [k] * len(mine)
            cols += mine
        if not texts:
            return np.zeros((0, len(model.names)))
        x = Rows(np.array(rows, int), np.array(cols, int), width, np.array(dense).reshape(-1, _DENSE))
        return model.probabilities(x) * np.array([bool(t) for t in texts])[:, None]

    return probabilities


def score_toxicity(docs: DataFrame, model: Chain, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text with the chain.

    Returns ``id_col``, ``p_<category>`` for each category, and ``toxic``:
    whether the last category reaches ``threshold``. Null and empty texts are
    never toxic and have probability 0 throughout. Null ids and repeated rows
    are scored like any other; an empty table gives an empty one; other columns
    are not read.
    """
    small_batches(docs.sparkSession)
    names = [f"p_{n}" for n in model.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities = judge(model)
        for batch in slices(batches):
            p = probabilities(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in p.T], pa.array(p[:, -1] >= threshold)], names=[id_col, *names, "toxic"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def drop_toxic(docs: DataFrame, model: Chain, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, as they are, whose text is not toxic.

    Null and empty texts stay; rows are judged one by one, so that repeated
    rows and null ids fare like any other; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities = judge(model)
        for batch in slices(batches):
            yield batch.filter(pa.array(probabilities(batch.column(at).to_pylist())[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
