"""Ranked lexical search, reversed: the items' inverted index is broadcast and every document is streamed through it.

Terms are the maximal matches of `TERM` in a whole text, A-Z lower-cased. A first pass turns each document into its term counts
over the items' vocabulary, written to the shared folder; their sums give document count, term total and document frequencies.
A second pass adds up integer scores, document by document, over the postings of its terms and keeps a bounded heap per item
in each task; the heaps of all tasks are merged by item.

Items are taken in blocks of at most `POSTINGS` postings (a single longer item is a block of its own), so the broadcast index and
the heaps have a fixed size whatever the number of items; all documents pass by once per block. Items of equal terms, repeated
rows among them, are ranked once and get equal rows.

A null or empty text has no terms: such a document is counted nowhere and found by no item, such an item has no rows. Rows
repeated with one doc_id are documents of their own, so an id can be ranked twice; null ids rank behind all others of their score.
Equal scores rank by doc_id. Very long texts are counted whole. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seafret.llm.common import text_of, written

#: What the terms are made of (fixed): ASCII letters and digits, and everything above ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Percent of the length norm that depends on length, saturation, scale of the integers (fixed values).
SHARE, SATURATION, SCALE = 90, 8, 1000
#: Postings (distinct terms of items) of one broadcast block.
POSTINGS = 1 << 19
TOP = 10

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(_FOLD).split()


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class Index:
    """Inverted index of a block of items: term numbers, and for each term the items that hold it."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.keys = [k for k, _ in items]
        vocabulary = sorted({t for _, terms in items for t in terms})
        self.numbers = {t: i for i, t in enumerate(vocabulary)}
        term = np.array([self.numbers[t] for _, terms in items for t in terms], np.int64)
        item = np.repeat(np.arange(len(items)), [len(terms) for _, terms in items])
        order = np.argsort(term, kind="stable")
        self.items = item[order].astype(np.int64)
        self.start = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))


def _counts(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = index.value.numbers
        for batch in batches:
            ids, totals, terms, tfs = batch.column(0), [], [], []
            texts = batch.column(1)
            for i in range(len(batch)):
                words = terms_of(texts[i].as_py())
                counted = Counter(words)
                known = sorted((numbers[w], tf) for w, tf in counted.items() if w in numbers)
                totals.append(len(words))
                terms.append([k for k, _ in known])
                tfs.append([tf for _, tf in known])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(totals, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    return run


def _frequencies(size: int):
    """Per task: documents with terms and their term total under number -1, then documents per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, total, df = 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            n = batch.column(0).to_numpy()
            documents += int(np.count_nonzero(n))
            total += int(n.sum())
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(([-1], seen)), pa.int64()), pa.array(np.concatenate(([documents], df[seen])), pa.int64()), pa.array([total] + [0] * len(seen), pa.int64())],
            ["term", "documents", "total"],
        )

    return run


class Heaps:
    """The best documents of each item of a block seen by a task."""

    def __init__(self, items: int, k: int):
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(items)]
        self.floor = np.zeros(items, np.int64)  # scores below it cannot enter
        self.k = k

    def update(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """`scores` of documents (rows) for items (columns)."""
        rows, items = np.nonzero((scores > 0) & (scores >= self.floor))
        for row, item, score in zip(rows.tolist(), items.tolist(), scores[rows, items].tolist()):
            doc = ids[row]
            entry = (score, 0 if doc is None else 1, 0 if doc is None else -doc)
            heap = self.heaps[item]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[item] = heap[0][0]


def scores_of(index: Index, weights: np.ndarray, m: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Scores of documents (rows numbered by `row`) for all items of the block, from one entry per document and term."""
    gain = weights[term] * (SCALE**3 * tf // (SCALE * tf + SATURATION * m[row]))
    begin, fan = index.start[term], index.start[term + 1] - index.start[term]
    entry = np.repeat(np.arange(len(term)), fan)
    item = index.items[begin[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(fan) - fan, fan)]
    out = np.zeros(len(m) * len(index.keys), np.int64)
    np.add.at(out, row[entry] * len(index.keys) + item, gain[entry])
    return out.reshape(len(m), len(index.keys))


def _search(index, statistics, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (documents, total, weights) = index.value, statistics.value
        heaps = Heaps(len(block.keys), k)
        step = max(1, min(1024, (1 << 21) // len(block.keys)))
        for batch in batches:
            for i in range(0, len(batch), step):
                some = batch.slice(i, step)
                n = some.column(1).to_numpy()
                m = 100 - SHARE + SHARE * n * documents // total
                row = np.repeat(np.arange(len(n)), np.diff(some.column(2).offsets.to_numpy()))
                term, tf = (some.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                heaps.update(scores_of(block, weights, m, row, term, tf), some.column(0).to_pylist())
        found = [(block.keys[i], -doc if known else None, score) for i, heap in enumerate(heaps.heaps) for score, known, doc in heap]
        columns = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_key", "doc_id", "score"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])


def _blocks(queries: DataFrame, postings: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Queries in blocks of at most `postings` postings, read one block after another."""
    held, block = 0, []
    for r in queries.toLocalIterator():
        terms = [bytes(t) for t in r["terms"]]
        if block and held + len(terms) > postings:
            yield block
            held, block = 0, []
        block.append((r["item_key"], terms))
        held += len(terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = TOP, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().cast("binary").alias("text"))
    termed = texts.mapInArrow(_item_terms, "item_id long, terms array<binary>").filter(F.size("terms") > 0)
    termed = termed.withColumn("mark", F.sha2(F.concat_ws(" ", F.transform("terms", lambda t: F.hex(t))), 256))
    termed = written(termed, "search-items")
    # equal items are one query
    queries = termed.groupBy("mark").agg(F.first("terms").alias("terms")).withColumn("item_key", F.monotonically_increasing_id())
    queries = written(queries, "search-queries")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    found = None
    for block in _blocks(queries.select("item_key", "terms"), postings):
        part = _block(spark, source, block, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    asked = queries.select("mark", "item_key").join(ranked, "item_key")
    return termed.select("mark", "item_id").join(asked, "mark").select("item_id", "rank", "doc_id", "score")


def _block(spark: SparkSession, source: DataFrame, block: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """The k best documents of every task for the items of a block."""
    made = Index(block)
    index = spark.sparkContext.broadcast(made)
    size = len(made.numbers)
    counts = written(source.mapInArrow(_counts(index), COUNTS).filter("n > 0"), "search-counts")
    sums = counts.select("n", "terms").mapInArrow(_frequencies(size), "term long, documents long, total long")
    documents, total, df = 0, 0, np.zeros(size, np.int64)
    for r in sums.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("total").alias("total")).collect():  # one row a term of the block
        if r["term"] < 0:
            documents, total = r["documents"], r["total"]
        else:
            df[r["term"]] = r["documents"]
    weights = np.array([weight(documents, int(f)) for f in df], np.int64)
    statistics = spark.sparkContext.broadcast((documents, total, weights))
    return counts.mapInArrow(_search(index, statistics, k), "item_key long, doc_id long, score long")
