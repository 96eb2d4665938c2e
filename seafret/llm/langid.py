"""Language of whole texts by a small convolutional network over bytes, trained in numpy.

Lower-cased UTF-8 bytes are cut into windows of fixed length; filters of several widths run over each window, the largest
value of each filter goes through one linear layer and softmax, and the windows' probabilities are averaged by their
length. A null text or one without a letter is `und` with score 0. Very long texts are just more windows; repeated rows
repeat their result; an empty table gives an empty result; without labelled rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from seafret.llm.common import written

#: Bytes of a window, filter widths, filters of each width.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The fit uses at most so many labelled texts in all and of each language, chosen by hash of their id, and so many windows of each.
FIT_TEXTS = 20_000
FIT_PER_LANG = 600
FIT_WINDOWS = 6
EPOCHS = 8
UND = "und"
#: Letters by Unicode category; numerals such as \u00b2, \u2460 or \u2167 are none.
LETTER = regex.compile(r"\p{L}")
#: The pipeline keeps a text if its language is known with at least this probability.
MIN_SCORE = 0.35


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows of bytes, zero-padded), how many each text has, how many bytes of each are text."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    count = np.maximum(-(-size // WINDOW), 1)
    flat = np.frombuffer(b"".join(r.ljust(int(c) * WINDOW, b"\0") for r, c in zip(raw, count)), np.uint8).reshape(-1, WINDOW)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
    used = np.clip(np.repeat(size, count) - at * WINDOW, 1, WINDOW)
    return flat, count, used


class ByteCnn:
    """A filter of width w is w tables of 256 weights, one for each offset: its value at a place is the sum of w entries."""

    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        # row 0 is padding and stays zero
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.tables:
            t[:, 0] = 0
        self.weights = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)
        self.pairs: list[list[np.ndarray]] | None = None

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter and where it is."""
        top, where = [], []
        for t in self.tables:
            w = len(t)
            n = x.shape[1] - w + 1
            v = t[0][x[:, :n]]
            for k in range(1, w):
                v += t[k][x[:, k : k + n]]
            at = v.argmax(axis=1)
            where.append(at)
            top.append(np.take_along_axis(v, at[:, None, :], 1)[:, 0])
        return np.concatenate(top, axis=1), where

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The same values with tables over byte pairs, which take half the lookups."""
        if self.pairs is None:
            self.pairs = [
                [(t[k][:, None] + t[k + 1][None, :]).reshape(1 << 16, FILTERS) for k in range(0, len(t) - 1, 2)] for t in self.tables
            ]
        duo = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
        top = []
        for t, pairs in zip(self.tables, self.pairs):
            w = len(t)
            n = x.shape[1] - w + 1
            v = pairs[0].take(duo[:, :n], axis=0)
            for k, p in enumerate(pairs[1:], 1):
                v += p.take(duo[:, 2 * k : 2 * k + n], axis=0)
            if w % 2:
                v += t[w - 1].take(x[:, w - 1 :], axis=0)
            top.append(v.max(axis=1))
        z = np.maximum(np.concatenate(top, axis=1), 0) @ self.weights + self.bias
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 128, seed: int = 5) -> None:
        """Adam on the cross-entropy; through the pooling only the place of the largest value learns."""
        rng = np.random.default_rng(seed)
        values = [*self.tables, self.weights, self.bias]
        first = [np.zeros_like(v) for v in values]
        second = [np.zeros_like(v) for v in values]
        step = 0
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                xb = x[idx]
                top, where = self.pooled(xb)
                act = np.maximum(top, 0)
                z = act @ self.weights + self.bias
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(idx)), y[idx]] -= 1
                p /= len(idx)
                back = (p @ self.weights.T) * (top > 0)
                grads = []
                for i, t in enumerate(self.tables):
                    g = np.zeros_like(t)
                    mine = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(len(t)):
                        letters = np.take_along_axis(xb, where[i] + k, 1)
                        np.add.at(g[k], (letters, np.arange(FILTERS)[None, :]), mine)
                    g[:, 0] = 0
                    grads.append(g)
                grads += [act.T @ p, p.sum(axis=0)]
                step += 1
                for v, g, m, s in zip(values, grads, first, second):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.pairs = None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        for group in _groups(able, texts):
            x, count, used = windows([texts[i] for i in group])
            p = np.concatenate([self.probabilities(x[k : k + 256]) for k in range(0, len(x), 256)])
            start = np.cumsum(count) - count
            mean = np.add.reduceat(p * used[:, None], start) / np.add.reduceat(used, start)[:, None]
            for i, k, s in zip(group, mean.argmax(axis=1), mean.max(axis=1)):
                langs[i], scores[i] = self.langs[k], min(float(s), 1.0)
        return langs, scores


def _groups(able: list[int], texts: list[str | None]) -> Iterator[list[int]]:
    group, size = [], 0
    for i in able:
        group.append(i)
        size += len(texts[i])
        if size > 1 << 21:
            yield group
            group, size = [], 0
    if group:
        yield group


def fit(docs: DataFrame) -> ByteCnn:
    """Learn from documents that are not held out and have a language and text.

    The network is fitted on the driver on a bounded sample: at most FIT_PER_LANG different texts of each language, FIT_TEXTS in all,
    those with the smallest hash, FIT_WINDOWS windows of each, cut on the executors. Repeated texts of a language count once, so
    neither copies nor a repeated id fill the sample or exceed its bound.
    """
    known = docs.select("lang", "text").filter(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    mark = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    counts = known.groupBy("lang").agg(F.approx_count_distinct(mark, 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(FIT_TEXTS)
    counts = written(counts, "languages")
    langs = counts.count()
    if not langs:
        return ByteCnn([])
    each = max(1, min(FIT_PER_LANG, FIT_TEXTS // langs))
    # a share by hash first, so that no language meets whole in one task; then the exact bound
    share = F.least(F.lit(1.0), F.lit(1.7 * each + 50) / F.col("n"))
    shares = F.broadcast(counts.select(F.col("lang").alias("__lang"), share.alias("__share")))
    few = known.select("lang", mark.alias("mark")).join(shares, F.col("lang") == F.col("__lang"))
    few = few.filter(F.pmod("mark", F.lit(1 << 30)) < F.col("__share") * (1 << 30)).select("lang", "mark").distinct()
    by_lang = Window.partitionBy("lang").orderBy(F.pmod("mark", F.lit(1 << 30)), "mark")
    ids = few.withColumn("n", F.row_number().over(by_lang)).filter(F.col("n") <= each)
    chosen = F.broadcast(ids.select(F.col("lang").alias("__lang"), F.col("mark").alias("__mark")))
    sample = known.withColumn("mark", mark).join(chosen, (F.col("lang") == F.col("__lang")) & (F.col("mark") == F.col("__mark")))
    # one row of each text: copies are combined before the shuffle
    sample = sample.groupBy("lang", "mark").agg(F.min("text").alias("text"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for one in frame.itertuples(index=False):
                if not LETTER.search(one.text):
                    continue
                x, _, used = windows([one.text])
                full = np.flatnonzero(used == WINDOW) if (used == WINDOW).any() else np.arange(len(x))
                at = full[np.unique(np.linspace(0, len(full) - 1, FIT_WINDOWS).astype(int))]
                yield pd.DataFrame({"mark": one.mark, "lang": one.lang, "bytes": [x[i].tobytes() for i in at]})

    got = sample.mapInPandas(cut, "mark long, lang string, bytes binary").toPandas().sort_values(["mark", "lang", "bytes"])
    net = ByteCnn(sorted(set(got["lang"])))
    if net.langs:
        x = np.frombuffer(b"".join(got["bytes"]), np.uint8).reshape(-1, WINDOW)
        net.fit(x, got["lang"].map(net.langs.index).to_numpy())
    return net


def predictor(net: ByteCnn):
    """Text column -> struct(lang, score)."""

    shape = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])

    @F.pandas_udf(shape)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = net.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang": langs, "score": scores})

    return predict


def identify(docs: DataFrame, net: ByteCnn | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `docs` (doc_id, text, and lang for the fit)."""
    net = net or fit(docs)
    told = docs.select("doc_id", predictor(net)(F.col("text")).alias("p"))
    return told.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_known(docs: DataFrame, net: ByteCnn | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows whose language is predicted with at least `min_score`; `und` rows go."""
    net = net or fit(docs)
    told = docs.withColumn("__lang", predictor(net)(F.col("text")))
    return told.filter((F.col("__lang.lang") != UND) & (F.col("__lang.score") >= min_score)).select(*docs.columns)
