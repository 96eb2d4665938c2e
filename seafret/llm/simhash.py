"""SimHash near duplicates by anchor-point covering.

Fingerprints are 64-bit. They are cut into blocks; if two differ in at most `MAX_BITS` bits, then in some block they
differ in no more than that block's threshold. In each block the codewords of a covering code are the anchors: a
fingerprint is at home at the anchor nearest to it (within the covering radius) and is copied to every anchor within
covering radius plus threshold, so of each close pair one meets the other at its home. Only fingerprints that differ are
compared; of the links at one anchor a forest is passed on, never all pairs.

A null or empty text has no words: its fingerprint is zero and is linked like any other. Repeated rows share a
fingerprint. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seafret.llm.common import attach, text_of, without, written

WORDS = 4
MAX_BITS = 4
SEED = 42


class Block(NamedTuple):
    """`bits` bits from `shift` on; the first `code` of them (0, 15 or 31) are covered by a Hamming code of radius 1."""

    shift: int
    bits: int
    code: int
    threshold: int

    @property
    def reach(self) -> int:
        return self.threshold + (1 if self.code else 0)


#: Thresholds plus one of all blocks add up to MAX_BITS + 1, so no close pair escapes. Few distinct fingerprints need few anchors;
#: beyond LARGE of them the two wide blocks keep the number of comparisons at each anchor down. Both find the same links.
THREE = (Block(0, 21, 15, 1), Block(21, 21, 15, 1), Block(42, 22, 0, 0))
TWO = (Block(0, 32, 31, 2), Block(32, 32, 31, 1))
LARGE = 1 << 24
#: Homes and copies of one anchor that one task compares at once, at most; larger anchors are cut.
ANCHOR_ROWS = 1 << 15
LARGE_ANCHORS = 1_000_000
PAIRS = 1 << 21


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Signed 64-bit value: a bit is set if it is set in over half of the shingle hashes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(len(tokens) - words + 1, 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 15):
        h = np.array([hashed(flat[a:b], SEED) for a, b in zip(starts[i : i + (1 << 15)], stops[i : i + (1 << 15)])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(marks, pa.int64())], ["doc_id", "text_mark", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_mark (hash of the text), fp of every row."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_mark"))
    return read.mapInArrow(_fingerprints(words), "doc_id long, text_mark long, fp long")


def _syndromes(values: np.ndarray, code: int) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for i in range(code):
        out ^= ((values >> i) & 1) * (i + 1)
    return out


def _errors(block: Block) -> list[np.ndarray]:
    """By syndrome: all bit patterns of weight up to `reach` that lead from a block with it to a codeword."""
    masks = np.array([sum(1 << i for i in c) for w in range(block.reach + 1) for c in combinations(range(block.bits), w)], np.int64)
    syn = _syndromes(masks, block.code)
    return [masks[syn == s] for s in range(block.code + 1)]


def anchors(fps: np.ndarray, block: Block, errors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint; then index and anchor of each copy."""
    part = (fps >> block.shift) & ((1 << block.bits) - 1)
    syn = _syndromes(part, block.code)
    flip = np.where(syn > 0, np.int64(1) << np.maximum(syn - 1, 0), 0)
    at, to = [], []
    for s, masks in enumerate(errors):
        own = np.flatnonzero(syn == s)
        at.append(np.repeat(own, len(masks)))
        to.append((part[own][:, None] ^ masks[None, :]).ravel())
    return part ^ flip, np.concatenate(at), np.concatenate(to)


def _spread(blocks: tuple[Block, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = [_errors(b) for b in blocks]
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(every), 2048):
                fps = every[i : i + 2048]
                for k, block in enumerate(blocks):
                    home, at, to = anchors(fps, block, errors[k])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((np.concatenate([home, to]) << 1) | (k & 1) if len(blocks) < 3 else np.concatenate([home, to]) * 4 + k),
                            pa.array(np.concatenate([np.ones(len(home), bool), np.zeros(len(at), bool)])),
                            pa.array(np.concatenate([fps, fps[at]])),
                        ],
                        ["anchor", "home", "fp"],
                    )

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value that the links a-b join, with the smallest value of its component, where they differ."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _close(homes: np.ndarray, copies: np.ndarray, hs: np.ndarray, cs: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs within groups: group g has homes[hs[g]:hs[g+1]] and copies[cs[g]:cs[g+1]]."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    per_home = np.repeat(np.diff(cs), np.diff(hs))
    first = np.repeat(cs[:-1], np.diff(hs))
    upto = np.concatenate(([0], np.cumsum(per_home)))
    i = 0
    while i < len(homes):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, "right")) - 1)
        n = per_home[i:j]
        left = np.repeat(homes[i:j], n)
        right = copies[np.repeat(first[i:j] - (upto[i:j] - upto[i]), n) + np.arange(int(upto[j] - upto[i]))]
        near = (left < right) & (np.bitwise_count((left ^ right).view(np.uint64)) <= max_bits)
        if near.any():
            found.append((left[near], right[near]))
            held += int(near.sum())
            if held > PAIRS:
                found = [forest(*map(np.concatenate, zip(*found)))]
                held = len(found[0][0])
        i = j
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(*map(np.concatenate, zip(*found)))


def _compare(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell that a batch cuts is carried over."""
        held: list[tuple[np.ndarray, ...]] = []

        def links(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            cell, home, fp = rows
            cells = np.unique(cell)
            edges = np.concatenate([cells, [cells[-1] + 1]]) if len(cells) else np.zeros(1, np.int64)
            hs, cs = np.searchsorted(cell[home], edges), np.searchsorted(cell[~home], edges)
            a, b = _close(fp[home], fp[~home], hs, cs, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(rows[0]):
                continue
            if rows[0][0] == rows[0][-1]:
                if held and held[0][0][0] != rows[0][0]:
                    yield links(tuple(map(np.concatenate, zip(*held))))
                    held = []
                held.append(rows)
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            held.append(tuple(x[:cut] for x in rows))
            yield links(tuple(map(np.concatenate, zip(*held))))
            held = [tuple(x[cut:] for x in rows)]
        if held:
            yield links(tuple(map(np.concatenate, zip(*held))))

    return run


def links(fps: DataFrame, blocks: tuple[Block, ...], max_bits: int = MAX_BITS) -> DataFrame:
    """Links a > b that join all fingerprints (column fp, distinct) with at most `max_bits` different bits."""
    if sum(b.threshold + 1 for b in blocks) <= max_bits:
        raise ValueError("the blocks' thresholds miss some close pairs")
    spread = fps.select("fp").mapInArrow(_spread(blocks), "anchor long, home boolean, fp long")
    counts = spread.groupBy("anchor", "home").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # a table of no more than two million rows of 16 bytes; these anchors are cut into cells of bounded size
    large = counts.filter(F.col("n") > max(ANCHOR_ROWS, total // LARGE_ANCHORS))
    parts = large.groupBy("anchor").agg(
        F.ceil(F.coalesce(F.max(F.when(F.col("home"), F.col("n"))), F.lit(1)) / ANCHOR_ROWS).cast("int").alias("hn"),
        F.ceil(F.coalesce(F.max(F.when(~F.col("home"), F.col("n"))), F.lit(1)) / ANCHOR_ROWS).cast("int").alias("cn"),
    )
    cut = spread.join(F.broadcast(parts), "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("hn")).otherwise(F.col("cn"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("home"), F.col("cn")).otherwise(F.col("hn")) - 1)
    met = F.when(F.col("hn").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(others, lambda o: F.when(F.col("home"), own * F.col("cn") + o).otherwise(o * F.col("cn") + own))
    )
    cells = cut.select("anchor", "home", "fp", F.explode(met).alias("part")).select(F.xxhash64("anchor", "part").alias("cell"), "home", "fp")
    dealt = cells.repartition(F.col("cell")).sortWithinPartitions("cell")
    return dealt.mapInArrow(_compare(max_bits), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (a, b): root is the smallest node of its component.

    Alternates two star steps until the edges no longer change; every round is a written table.
    """
    def hook(pairs: DataFrame, keep) -> DataFrame:
        """For node u with neighbours v: (v, m) for those to keep, where m is the smallest of u and all v."""
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        low = written(low, "cc-low")
        met = attach(pairs, low, "u", "n")
        return met.select(F.explode(keep(F.col("u"), F.col("v"), F.col("m"))).alias("e")).select("e.a", "e.b")

    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        wide = hook(both, lambda u, v, m: F.when(v > u, F.array(pair(v, m))).otherwise(none)).distinct()
        wide = written(wide, "cc-wide")
        down = wide.select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = written(
            hook(down, lambda u, v, m: F.array(pair(u, m), pair(v, m))).filter("a <> b").distinct(), "cc-edges"
        )
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, blocks: tuple[Block, ...] | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component), kept, text_mark of every row.

    Of a component the row with the smallest doc_id is kept (without ids: with the smallest text_mark); rows without an id
    count as members, and a component of such rows only has a null component_id.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_mark")).alias("least")
    groups = written(rows.groupBy("fp").agg(least, F.count(F.lit(1)).alias("n")), "fingerprint-groups")
    blocks = blocks or (THREE if groups.count() <= LARGE else TWO)
    found = written(links(groups, blocks, max_bits), "simhash-links")
    roots = components(found)
    # one row per distinct fingerprint in both, so no key is hot
    rooted = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    rooted = written(rooted, "simhash-roots")
    classes = written(rooted.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("fps")), "simhash-classes")
    named = written(attach(rooted.select("fp", "root", "n"), classes, "root", "fps").select("fp", "first", "n"), "simhash-named")
    told = attach(rows, named, "fp", "n")
    kept = told["doc_id"].eqNullSafe(told["first.doc_id"]) & (told["text_mark"] == told["first.text_mark"])
    return told.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        kept.alias("kept"),
        "text_mark",
    )


def keep_first(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with all its columns (a row repeated whole is one document)."""
    gone = written(near_duplicates(docs, words, max_bits).filter(~F.col("kept")).select("doc_id", "text_mark").distinct(), "near-gone")
    return without(docs, gone, {"doc_id": F.col("doc_id"), "text_mark": F.xxhash64(text_of())})
