"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens: positions marked 1 are hashed, the others are ignored, so a substituted token
there does not hide a match. Test and training hashes are joined; around each hit the two token sequences are laid over each
other and compared, substitutions allowed.

Tokens are runs of letters and digits, lower-cased. Null and empty texts have no tokens and never match. Items of fewer than
six tokens, the shortest seed, cannot be told from common phrases and never match. An item is its id and text: rows repeated with both
are one item, items without an id are matched like others and reported with a null id. Repeated rows repeat their result, ties among alignments go to the
longest, then the smallest item and offset; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seafret.llm.common import SHARE, bounded, text_of, without, written

TOKEN = re.compile(r"[^\W_]+")
#: 1: hashed, 0: ignored. Every mask has weight 6; two substitutions at most three tokens apart never break all of them.
MASKS = ("111111", "1110111", "11011011", "101011011", "110100111")
#: An overlap counts if at least MIN_TOKENS tokens are equal (of shorter items IDENTITY of their tokens), at least IDENTITY of the
#: overlap is, and it has at least COVER of the item's tokens or LONG tokens.
MIN_TOKENS = 8
IDENTITY = 0.8
COVER = 0.5
LONG = 13
#: Tokens kept on both sides of a hit for the comparison.
AROUND = 128
#: Bits of the filter over test hashes: at most so many, whatever the size of the benchmark.
FILTER_BITS = 1 << 27
#: Tokens of documents whose seeds are made together.
TOGETHER = 1 << 15
#: Parts of a heavy seed.
SALTS = 64


class _Hashes(dict):
    """Hash of every token seen, forgotten when there are too many."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = made = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 11)
        return made


def token_hashes(text: str, memory: _Hashes | None = None) -> np.ndarray:
    memory = _Hashes() if memory is None else memory
    tokens = TOKEN.findall(text.lower())
    return np.fromiter(map(memory.__getitem__, tokens), np.uint64, len(tokens))


#: Odd factors by mask and place in it.
FACTORS = [np.array([xxhash.xxh64_intdigest(f"{m} {i}".encode(), 3) | 1 for i in range(len(m))], np.uint64) for m in MASKS]


def seeds(x: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the mask at every place of a sequence of mixed token hashes."""
    shape = MASKS[mask]
    n = len(x) - len(shape) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, mask + 1, np.uint64)
    for i, c in enumerate(shape):
        if c == "1":
            out += x[i : i + n] * FACTORS[mask][i]
    out ^= out >> np.uint64(31)
    return out


def all_seeds(h: np.ndarray) -> Iterator[np.ndarray]:
    """For every mask its hash at each place of a token sequence; a sequence shorter than a mask has none of it."""
    x = h ^ (h >> np.uint64(29))
    for mask in range(len(MASKS)):
        yield seeds(x, mask)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = token_hashes(text or "")
            for s in all_seeds(h):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.view(np.int64)), pa.array(np.full(len(s), item, np.int64)), pa.array(np.arange(len(s), dtype=np.int32))], ["seed", "item", "item_at"]
                )


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [token_hashes(t or "").view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int64()))], ["item", "item_tokens"])


def _probes(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    s = seed.view(np.uint64)
    size = np.uint64(bits - 1)
    return (s & size).view(np.int64), ((s >> np.uint64(32)) & size).view(np.int64)


def hash_filter(item_seeds: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap over all test hashes, merged from the tasks; its size is bounded by `bits`, a power of two."""
    n = item_seeds.count()
    bits = min(bits, 1 << max(16, int(max(n, 1) * 256).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, bool)
        for batch in batches:
            for probe in _probes(batch.column(0).to_numpy(zero_copy_only=False), bits):
                table[probe] = True
        packed = np.packbits(table).view(">u8").astype(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["at", "word"])

    got = item_seeds.select("seed").mapInArrow(mark, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    packed = np.zeros(bits // 64, np.int64)
    packed[got["at"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64)
    return packed.astype(">u8").view(np.uint8)


def _hits(h: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, place and document of all hashes that may be test hashes, by place, in documents laid end to end."""
    seed, place, owner = [], [], []
    for mask, s in enumerate(all_seeds(h)):
        at = np.flatnonzero(table[(s & np.uint64(len(table) - 1)).view(np.int64)])
        at = at[table[_probes(s[at], len(table))[1]]]
        doc = np.searchsorted(ends, at, "right")
        inside = at + len(MASKS[mask]) <= ends[doc]
        seed.append(s[at[inside]])
        place.append(at[inside])
        owner.append(doc[inside])
    seed, place, owner = np.concatenate(seed), np.concatenate(place), np.concatenate(owner)
    order = np.argsort(place, kind="stable")
    return seed[order], place[order], owner[order]


def _segments(packed: np.ndarray):
    """Parts of documents around places whose hash may be a test hash, with those places.

    Seeds of documents next to each other are made together, as most documents are too short for whole-array work.
    """

    def found(docs: list[tuple], table: np.ndarray) -> Iterator[tuple]:
        h, ends = np.concatenate([d[2] for d in docs]), np.cumsum([len(d[2]) for d in docs])
        seed, place, owner = _hits(h, ends, table)
        apart = (np.diff(place) > 2 * AROUND) | (np.diff(owner) > 0)
        for part in np.split(np.arange(len(place)), np.flatnonzero(apart) + 1) if len(place) else ():
            doc, mark, own = docs[owner[part[0]]]
            at = place[part] - (ends[owner[part[0]]] - len(own))
            start, stop = max(0, int(at[0]) - AROUND), int(at[-1]) + AROUND
            yield doc, mark, start, own[start:stop].view(np.int64), seed[part].view(np.int64), at.astype(np.int32) - start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(packed).view(bool)
        memory = _Hashes()
        types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        for batch in batches:
            rows: list[tuple] = []
            docs: list[tuple] = []
            size = 0
            for i, (doc, text, mark) in enumerate(zip(batch.column(0), batch.column(1), batch.column(2)), 1):
                h = token_hashes(text.as_py(), memory)
                docs.append((doc.as_py(), mark.as_py(), h))
                size += len(h)
                if size >= TOGETHER or i == batch.num_rows:
                    rows += found(docs, table)
                    docs, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["doc_id", "text_mark", "start", "tokens", "seeds", "places"]
            )

    return run


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """Longest stretch of an alignment that starts and ends with an equal token and has at least IDENTITY of them equal.

    Returns begin, end and number of equal tokens; the first of several longest.
    """
    hits = np.flatnonzero(equal)
    if not len(hits):
        return 0, 0, 0
    # stretch i..j is good if good(j) >= good(i), with every equal token worth 1 - IDENTITY and every other -IDENTITY
    score = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - IDENTITY, -IDENTITY)))) + 1e-9 * np.arange(len(equal) + 1)
    before, after = score[hits], score[hits + 1]
    lowest = np.minimum.accumulate(before)
    # for each end the earliest begin whose score is not higher: the running minimum falls, so search it reversed
    first = np.searchsorted(-lowest, -after, "left")
    length = hits + 1 - hits[np.minimum(first, len(hits) - 1)]
    j = int(np.argmax(length))
    i = int(first[j])
    return int(hits[i]), int(hits[j]) + 1, j - i + 1


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            doc, item = np.asarray(r.tokens), np.asarray(r.item_tokens)
            lo, hi = max(0, r.shift), min(len(doc), r.shift + len(item))
            if hi <= lo:
                continue
            a, b, same = best_run(doc[lo:hi] == item[lo - r.shift : hi - r.shift])
            if same >= min(MIN_TOKENS, math.ceil(IDENTITY * len(item))) and (b - a >= LONG or b - a >= COVER * len(item)):
                out.append((r.doc_id, r.text_mark, r.item, r.start + lo + a, lo - r.shift + a, b - a, same, len(item)))
        yield pd.DataFrame(out, columns=["doc_id", "text_mark", "item", "doc_at", "item_at", "overlap", "matched", "item_tokens"])


def _met(hits: DataFrame, item_seeds: DataFrame) -> DataFrame:
    """Hits with the items' seeds. A benchmark within the broadcast bound is broadcast; beyond it a seed with at least 1/SHARE of
    all hits (a phrase that many documents share) is kept out of the shuffle by salt, its few item rows being copied to each salt."""
    small = bounded(item_seeds)
    if small is not item_seeds:
        return hits.join(small, "seed")
    hits = written(hits, "bench-seed-hits")
    counts = written(hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n")), "bench-seed-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(counts.filter(F.col("n") * SHARE >= total).select("seed", F.lit(True).alias("heavy")))  # at most SHARE seeds
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("segment", "place"), F.lit(SALTS))).otherwise(0)
    dealt = hits.join(heavy, "seed", "left").withColumn("salt", salt).drop("heavy")
    copies = F.when(F.col("heavy"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    spread = item_seeds.join(heavy, "seed", "left").withColumn("salt", F.explode(copies)).drop("heavy")
    return dealt.join(spread, ["seed", "salt"]).drop("salt")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, doc_at, item_at, overlap, matched, item_tokens, text_mark.

    A document is an id and a text (text_mark is its hash), so rows without an id are told apart. Of several overlaps of a pair the longest is given. Places are counted in tokens.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    rows = rows.groupBy("item_id", F.xxhash64("text").alias("item")).agg(F.min("text").alias("text"))
    named = written(rows, "bench-items")
    # items with one text are compared once
    items = written(named.groupBy("item").agg(F.min("text").alias("text")), "bench-texts")
    item_seeds = written(items.mapInArrow(_item_seeds, "seed long, item long, item_at int"), "bench-seeds")
    item_tokens = written(items.mapInArrow(_item_tokens, "item long, item_tokens array<long>"), "bench-tokens")
    packed = hash_filter(item_seeds)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_mark"))
    found = read.mapInArrow(_segments(packed), "doc_id long, text_mark long, start int, tokens array<long>, seeds array<long>, places array<int>")
    segments = written(found.withColumn("segment", F.monotonically_increasing_id()), "bench-segments")
    hits = segments.select("segment", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
    hits = hits.select("segment", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
    met = _met(hits, item_seeds).select("segment", "item", (F.col("place") - F.col("item_at")).alias("shift"))
    met = written(met.distinct(), "bench-hits")
    pairs = met.join(segments.select("segment", "doc_id", "text_mark", "start", "tokens"), "segment").join(bounded(item_tokens, 20_000), "item")
    checked = pairs.select("doc_id", "text_mark", "item", "start", "shift", "tokens", "item_tokens").mapInPandas(
        _verify, "doc_id long, text_mark long, item long, doc_at long, item_at long, overlap long, matched long, item_tokens long"
    )
    best = F.max(F.struct("overlap", "matched", (-F.col("doc_at")).alias("d"), (-F.col("item_at")).alias("i"), "item_tokens")).alias("b")
    checked = checked.groupBy("doc_id", "text_mark", "item").agg(best)
    return checked.join(bounded(named.select("item", "item_id")), "item").select(
        "doc_id", "item_id", (-F.col("b.d")).alias("doc_at"), (-F.col("b.i")).alias("item_at"), "b.overlap", "b.matched", "b.item_tokens", "text_mark"
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows that share no passage with the benchmark."""
    gone = written(overlaps(docs, benchmark).select("doc_id", "text_mark").distinct(), "contaminated")
    return without(docs, gone, {"doc_id": F.col("doc_id"), "text_mark": F.xxhash64(text_of())})
