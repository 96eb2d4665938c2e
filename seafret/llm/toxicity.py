"""Toxicity by a classifier chain over hashed words.

Categories are predicted one after the other; the linear model of each sees the words of a text and the probabilities of all earlier
categories. For training, those probabilities are out of fold: a labelled text is scored by models that have not seen it.

Words are runs of letters and digits, lower-cased, and runs of signs; a line in capitals counts as a word too. A text counts each
word once. A model weighs only the words that are clearly more or less frequent with its category than without. A null or empty text has no words and gets each
model's bias; it is never called toxic. Texts of any length are read whole. Labels may be null (not used for that category) and
texts unlabelled. Without labels of a category its probability is 0. Of repeated labels of a text the largest counts; repeated rows
repeat their result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seafret.llm.common import text_of

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")
WORD = re.compile(r"[^\W_]")
CAPITALS = "<capitals>"
CHAIN = ("quality", "toxic")
#: Hashed words, and the bounded sample the models are fitted on: the labelled texts with the smallest hash of their id.
BITS = 22
FIT_ROWS = 12_000
#: Words in fewer labelled texts than this get no weight.
MIN_TEXTS = 2
#: Least distance of a word's texts with the category from the expected number, in standard deviations.
CLEAR = 3.0
FOLDS = 4
EPOCHS = 30
LIMIT = 0.3


def vocabulary(text: str) -> set[str]:
    found = set(TOKEN.findall(text.lower()))
    return found | {CAPITALS} if any(map(str.isupper, text.split("\n"))) else found


def hashed(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 9) & ((1 << BITS) - 1)


def words(text: str) -> np.ndarray:
    """Hashed words of a text, each once."""
    return np.unique(np.array([hashed(w) for w in vocabulary(text)], np.int64))


def clear(rows: list[np.ndarray], y: np.ndarray, n_words: int) -> np.ndarray:
    """Words whose number of texts with the category is far from what chance gives."""
    flat, start = _flat(rows)
    total = np.bincount(flat, minlength=n_words)
    seen = np.bincount(flat, np.repeat(y, np.diff(start)), n_words)
    share = y.mean()
    return np.abs(seen - total * share) >= CLEAR * np.sqrt(total * share * (1 - share) + 1)


class Linear:
    """Logistic regression on sets of words and a few dense inputs, by Adagrad."""

    def __init__(self, n_words: int, n_dense: int):
        self.w, self.dense, self.bias = np.zeros(n_words), np.zeros(n_dense), 0.0

    def margin(self, flat: np.ndarray, start: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return _sums(self.w[flat], start) + dense @ self.dense + self.bias

    def fit(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, shrink: float = 1e-5) -> Linear:
        chosen = clear(rows, y, len(self.w))
        rows = [r[chosen[r]] for r in rows]
        rng = np.random.default_rng(3)
        seen, seen_dense, seen_bias = np.full(len(self.w), 1e-6), np.full(len(self.dense), 1e-6), 1e-6
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                flat, start = _flat([rows[i] for i in idx])
                p = probability(self.margin(flat, start, dense[idx]))
                err = (p - y[idx]) / len(idx)
                per_word = np.repeat(err, np.diff(start))
                at, inv = np.unique(flat, return_inverse=True)
                g = np.bincount(inv, per_word, len(at)) + shrink * self.w[at]
                seen[at] += g * g
                self.w[at] -= rate * g / np.sqrt(seen[at])
                if len(self.dense):
                    g = err @ dense[idx]
                    seen_dense += g * g
                    self.dense -= rate * g / np.sqrt(seen_dense)
                seen_bias += err.sum() ** 2
                self.bias -= rate * err.sum() / np.sqrt(seen_bias)
        return self


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    start = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    return (np.concatenate(rows) if rows else np.empty(0, np.int64)), start


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[start[1:]] - total[start[:-1]]


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """Limit with the best F1 of out-of-fold probabilities, half-way to the next lower one; LIMIT where there is nothing to choose by.

    Of equally good limits the highest.
    """
    if not (y > 0).any() or (y > 0).all():
        return LIMIT
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(y[order] > 0)
    last = np.flatnonzero(np.append(np.diff(p) != 0, True))  # a limit lies between different probabilities
    f1 = 2 * hit[last] / (last + 1 + hit[-1])
    at = last[int(np.argmax(f1))]
    below = p[at + 1] if at + 1 < len(p) else 0.0
    return float((p[at] + below) / 2)


class Chain:
    """One linear model per category, each fed with the earlier categories' probabilities."""

    def __init__(self, categories: tuple[str, ...] = CHAIN):
        self.categories = categories
        self.models: list[Linear | None] = []
        self.limit = LIMIT
        self.index: dict[int, int] = {}

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chain:
        """rows: hashed words; labels: one column per category, NaN where unknown; folds: fold of each row."""
        if not rows:
            self.models = [None] * len(self.categories)
            return self
        flat, _ = _flat(rows)
        word, texts = np.unique(flat, return_counts=True)
        word = word[texts >= MIN_TEXTS]
        self.index = {int(w): i for i, w in enumerate(word)}
        place = np.searchsorted(word, flat) if len(word) else flat
        known = np.isin(flat, word)
        cuts = np.cumsum([len(r) for r in rows])[:-1]
        rows = [p[k] for p, k in zip(np.split(place, cuts), np.split(known, cuts))]
        dense = np.empty((len(rows), 0))
        for c in range(len(self.categories)):
            y = labels[:, c]
            have = np.flatnonzero(~np.isnan(y))
            if not len(have):
                self.models.append(None)
                out = np.zeros(len(rows))
            else:
                out = np.empty(len(rows))
                for f in range(FOLDS):
                    use = have[folds[have] != f]
                    part = np.flatnonzero(folds == f)
                    if not len(part):
                        continue
                    use = use if len(use) else have
                    model = Linear(len(word), dense.shape[1]).fit([rows[i] for i in use], dense[use], y[use])
                    out[part] = probability(model.margin(*_flat([rows[i] for i in part]), dense[part]))
                self.models.append(Linear(len(word), dense.shape[1]).fit([rows[i] for i in have], dense[have], y[have]))
                if c == len(self.categories) - 1:
                    self.limit = best_limit(out[have], y[have])
            dense = np.column_stack([dense, out])
        return self

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities of all categories; rows are places in the fitted vocabulary."""
        flat, start = _flat(rows)
        dense = np.empty((len(rows), 0))
        for model in self.models:
            p = np.zeros(len(rows)) if model is None else probability(model.margin(flat, start, dense))
            dense = np.column_stack([dense, p])
        return dense


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CHAIN, most: int = FIT_ROWS) -> Chain:
    """Fit on the driver on at most `most` labelled texts; only their hashed words are collected.

    Rows repeated with one id and text count once, and the bound holds for rows, not only for ids.
    """
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.col(f"`{c}`")).cast("double").alias(c) for c in categories])
    marks = marks.withColumn("order", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("order", "doc_id").limit(most)
    marks = F.broadcast(marks.select(F.col("doc_id").alias("__id"), "order", *categories))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [words(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), *batch.columns[1:]], ["words", "order", *categories])

    picked = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("__id")).select(text_of().alias("text"), "order", *categories)
    # copies are combined before the shuffle
    picked = picked.groupBy(F.xxhash64("text").alias("mark"), "order").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in categories])
    picked = picked.orderBy("order", "mark").limit(most).select("text", "order", *categories)
    shape = "words array<long>, order long, " + ", ".join(f"`{c}` double" for c in categories)
    got = picked.mapInArrow(read, shape).toPandas()
    got["n"] = got["words"].map(len)
    got = got.sort_values(["order", "n"]).reset_index(drop=True)
    folds = (got["order"].to_numpy(np.int64).view(np.uint64) % np.uint64(FOLDS)).astype(int) if len(got) else np.empty(0, int)
    return Chain(categories).fit([np.asarray(w, np.int64) for w in got["words"]], got[list(categories)].to_numpy(float), folds)


def score(docs: DataFrame, chain: Chain, limit: float | None = None) -> DataFrame:
    """doc_id, p_<category> of every category, toxic (the last category's probability is at least `limit`, which the fit chooses out of fold)."""
    names = [f"p_{c}" for c in chain.categories]
    limit = chain.limit if limit is None else limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = chain.index
        memory: dict[str, int] = {}

        def places(text: str) -> np.ndarray:
            found = vocabulary(text)
            if len(memory) > 500_000:
                memory.clear()
            for w in found.difference(memory):
                memory[w] = index.get(hashed(w), -1)
            at = np.unique(np.fromiter(map(memory.__getitem__, found), np.int64, len(found)))
            return at[at >= 0]

        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = [t.as_py() for t in part.column(1)]
                p = chain.predict([places(t) for t in texts])
                toxic = (p[:, -1] >= limit) & np.array([bool(WORD.search(t)) for t in texts], bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1])], pa.array(toxic)], ["doc_id", *names, "toxic"]
                )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return read.mapInArrow(run, "doc_id long, " + ", ".join(f"`{n}` double" for n in names) + ", toxic boolean")


def classify(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CHAIN) -> DataFrame:
    return score(docs, fit(docs, labels, categories))
