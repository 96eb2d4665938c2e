"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text becomes a vector of statistics (lengths, shares of character kinds, repetition, compressibility), shares on a
log-odds scale with pseudo-counts and lengths on a log scale; then each is standardised and bent towards `BEND` deviations, so
that no single odd value decides alone. Class means and second moments are sums, merged by Spark over all labelled training
rows; no sample is drawn. A class covariance is shrunk towards the pooled one and towards a multiple of the identity. Both
shares of shrinkage are the ones with the least log loss over `FOLDS` folds of the training rows, whose models come from the same
sums less those of the fold. Each covariance is factored once (Cholesky); a score is the logistic function of the difference of
the log densities (half squared Mahalanobis distances and log determinants) and log priors, tempered by a factor chosen with the
shrinkage.

Null and empty texts are scored like other texts, from their zero counts. Labels of an id that has several different ones, and
null labels, are not learned from; repeated rows of one id and vector count once in the fit and get one result each; ids held out
are never learned from. A null id is not held out and has no label. With labels of one class only every score is that class's
(0 or 1), without any label 0.5. Empty tables give an empty result; other columns of documents are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seafret.llm.common import bounded, text_of, written

#: Held-out ids have this remainder of crc32 by `MODULUS` (fixed by the query's contract).
MODULUS, HELD_OUT = 5, 0
#: Least score of a text predicted to be good.
CUT = 0.3
FOLDS = 4
#: Shares of the pooled covariance, of the identity, and factors on the log ratio that are tried.
POOLED, IDENTITY, TEMPER = (0.0, 0.1, 0.3, 0.6, 1.0), (0.001, 0.01, 0.1, 0.3), (0.1, 0.2, 0.35, 0.6, 1.0)
BEND = 4.0

_KINDS = np.zeros(256, np.int8)  # 0 others, 1 small, 2 capital, 3 digit, 4 white, 5 sentence marks, 6 other marks, 7 lead byte, 8 continuation
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = (
        8 if 0x80 <= _b < 0xC0 else 7 if _b >= 0xC0 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit()
        else 4 if _c.isspace() else 5 if _c in ".,;:'\"-()" else 6 if _c.isprintable() else 0
    )
_ENDS = tuple(".!?…。！？:;\"”»)")

STATISTICS = (
    "chars", "words", "word_length", "word_spread", "capitals", "digits", "white", "sentence_marks", "other_marks", "controls", "beyond_ascii",
    "loud", "distinct_words", "top_word", "same_as_before", "marked_words", "bare_words", "long_words", "one_letter", "line_length", "repeated_lines", "ended_lines",
    "words_a_sentence", "packed",
)


def _odds(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of a UTF-8 text, in the order of STATISTICS."""
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=9).tolist()
    text = raw.decode("utf-8", "replace")
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, k = len(text), len(words)
    letters = kinds[1] + kinds[2] + kinds[7]
    lengths = list(map(len, words))
    mean = sum(lengths) / k if k else 0.0
    spread = math.sqrt(max(sum(x * x for x in lengths) / k - mean * mean, 0)) if k else 0.0
    counted = Counter(words)
    top = max(counted.values(), default=0)
    sentences = text.count(". ") + text.count(".\n") + text.count("! ") + text.count("? ") + text.endswith((".", "!", "?"))
    return [
        math.log1p(n),
        math.log1p(k),
        math.log1p(mean),
        math.log1p(spread),
        _odds(kinds[2], letters),
        _odds(kinds[3], n),
        _odds(kinds[4], n),
        _odds(kinds[5], n),
        _odds(kinds[6], n),
        _odds(kinds[0], n),
        _odds(kinds[7], n),
        _odds(sum(map(str.isupper, words)), k),
        math.log1p(len(counted)) / math.log1p(k) if k else 1.0,
        _odds(top, k),
        _odds(sum(map(eq, words, words[1:])), k),
        _odds(k - sum(map(str.isalnum, words)), k),
        _odds(k - sum(map(_has_letter, words)), k),
        _odds(sum(x > 20 for x in lengths), k),
        _odds(lengths.count(1), k),
        math.log1p(n / len(lines)) if lines else 0.0,
        _odds(len(lines) - len(set(lines)), len(lines)),
        _odds(sum(line.rstrip().endswith(_ENDS) for line in lines), len(lines)),
        math.log1p(k / (sentences + 1)),
        math.log((len(zlib.compress(raw, 1)) + 1) / (len(raw) + 1)),
    ]


def _has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(batch.column(1)[i].as_py()) for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, x: statistics of every text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return source.mapInArrow(_vectors, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % MODULUS == HELD_OUT, F.lit(False))


@dataclass
class Scaler:
    mean: np.ndarray
    deviation: np.ndarray

    def bent(self, x: np.ndarray) -> np.ndarray:
        return BEND * np.tanh((x - self.mean) / self.deviation / BEND)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log constants of both classes."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    temper: float

    def log_ratio(self, z: np.ndarray) -> np.ndarray:
        """Log density and prior of class 1 less those of class 0."""
        sides = [c - 0.5 * np.square((z - m) @ f.T).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return sides[1] - sides[0]

    def scores(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.temper * self.log_ratio(z), -500, 500)))


def discriminant(sums: np.ndarray, pooled: float, identity: float, temper: float = 1.0) -> Discriminant:
    """From per-class sums (n, sum z, sum z z^T as one row each) of both classes."""
    p = len(STATISTICS)
    n = sums[:, 0]
    means = sums[:, 1 : 1 + p] / n[:, None]
    within = [s[1 + p :].reshape(p, p) - k * np.outer(m, m) for s, k, m in zip(sums, n, means)]
    shared = (within[0] + within[1]) / max(n.sum() - 2, 1)
    factors, constants = [], []
    for w, k in zip(within, n):
        own = w / max(k - 1, 1)
        cov = (1 - pooled) * own + pooled * shared
        # a floor keeps the factor defined where no statistic varies
        cov = (1 - identity) * cov + (identity * np.trace(cov) / p + 1e-6) * np.eye(p)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        constants.append(math.log(k / n.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(factors), np.array(constants), temper)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _moments(scaler: Scaler | None):
    """Per task, fold and class: row count, sums and products of the (scaled) vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column(2)) if len(batch) else np.zeros((0, len(STATISTICS)))
            z = x if scaler is None else scaler.bent(x)
            group = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            for g in np.unique(group).tolist():
                some = z[group == g]
                products = np.square(some).sum(axis=0) if scaler is None else (some.T @ some).ravel()
                row = np.concatenate(([len(some)], some.sum(axis=0), products))
                held[g] = held.get(g, 0) + row
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([g // 2 for g in keys], pa.int32()), pa.array([g % 2 for g in keys], pa.int32()), pa.array([held[g] for g in keys], pa.list_(pa.float64()))],
            ["fold", "label", "sums"],
        )

    return run


def _collected(rows: DataFrame, scaler: Scaler | None) -> dict[tuple[int, int], np.ndarray]:
    """Sums by fold and class: FOLDS x 2 rows whatever the input."""
    p = len(STATISTICS)
    width = 1 + 2 * p if scaler is None else 1 + p + p * p
    parts = rows.select("fold", "label", "x").mapInArrow(_moments(scaler), "fold int, label int, sums array<double>")
    merged = parts.groupBy("fold", "label").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    return {(r["fold"], r["label"]): np.array(r["sums"]) for r in merged.collect()}


def _losses(scaler: Scaler, models: dict[int, list[Discriminant]]):
    """Per task: summed log loss of every candidate on the rows of the fold it has not seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(next(iter(models.values()))) * len(TEMPER))
        for batch in batches:
            if not len(batch):
                continue
            z, fold, label = scaler.bent(_matrix(batch.column(2))), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for f, candidates in models.items():
                mine = fold == f
                if mine.any():
                    sign = np.where(label[mine] == 1, -1.0, 1.0)
                    ratios = [m.log_ratio(z[mine]) * sign for m in candidates]
                    total += [np.logaddexp(0, t * r).sum() for r in ratios for t in TEMPER]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["candidate", "loss"])

    return run


def training_rows(x: DataFrame, labels: DataFrame) -> DataFrame:
    """fold, label, x of the rows to learn from, repeated rows once."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("label"))
    known = known.filter(F.col("__id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.min("label").alias("label"), F.max("label").alias("__other")).filter("label = __other")
    learned = x.filter(~held_out(F.col("doc_id"))).join(bounded(known.drop("__other")), F.col("doc_id") == F.col("__id"))
    learned = learned.groupBy("doc_id", "x", "label").agg(F.lit(1))
    return learned.select((F.crc32(F.concat(F.lit("fold"), F.col("doc_id"))) % FOLDS).cast("int").alias("fold"), "label", "x")


@dataclass
class Model:
    scaler: Scaler | None
    discriminant: Discriminant | None
    constant: float
    pooled: float = 0.0
    identity: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.discriminant is None:
            return np.full(len(x), self.constant)
        return self.discriminant.scores(self.scaler.bent(x))


def fit(x: DataFrame, labels: DataFrame) -> Model:
    """Learns from all labelled rows of `vectors` that are not held out."""
    rows = written(training_rows(x, labels), "quality-training")
    first = _collected(rows, None)
    classes = {c for _, c in first}
    if len(classes) < 2:
        return Model(None, None, 0.5 if not classes else float(classes.pop()))
    p = len(STATISTICS)
    total = sum(first.values())
    mean = total[1 : 1 + p] / total[0]
    deviation = np.sqrt(np.maximum(total[1 + p :] / total[0] - mean * mean, 0))
    scaler = Scaler(mean, np.where(deviation > 1e-9, deviation, 1.0))
    sums = _collected(rows, scaler)
    whole = np.array([sum(s for (_, c), s in sums.items() if c == k) for k in (0, 1)])
    grid = [(a, b) for a in POOLED for b in IDENTITY]
    models = {}
    for fold in {f for f, _ in sums}:
        left = whole - np.array([sums.get((fold, k), np.zeros(len(whole[0]))) for k in (0, 1)])
        if left[:, 0].min() >= 2:
            models[fold] = [discriminant(left, a, b) for a, b in grid]
    a, b, t = POOLED[2], IDENTITY[1], 1.0
    if models:
        losses = rows.mapInArrow(_losses(scaler, models), "candidate int, loss double").groupBy("candidate").agg(F.sum("loss").alias("loss"))
        best = min(losses.collect(), key=lambda r: (r["loss"], r["candidate"]))["candidate"]
        (a, b), t = grid[best // len(TEMPER)], TEMPER[best % len(TEMPER)]
    return Model(scaler, discriminant(whole, a, b, t), 0.5, a, b)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`."""
    x = written(vectors(docs), "quality-vectors")
    model = fit(x, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_matrix(batch.column(1))))], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
