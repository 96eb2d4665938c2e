import numpy as np
import pytest
import xxhash

from frames import empty, messy, rows
from seafret.llm import simhash
from seafret.llm.simhash import THREE, TWO


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("blocks", [THREE, TWO])
def test_documents_against_brute_force(spark, blocks):
    got = simhash.near_duplicates(messy(spark), blocks=blocks).collect()
    marks = [plain_fingerprint(t) for _, t, *_ in rows()]
    comp = plain_components(sorted(set(marks)))
    least = {}
    for (doc_id, *_), m in zip(rows(), marks):
        if doc_id is not None:
            least[comp[m]] = min(doc_id, least.get(comp[m], doc_id))
    want = sorted((str(i), f"{m:016x}", str(least.get(comp[m]))) for (i, *_), m in zip(rows(), marks))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def planted(seed):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)]
    out = set(base)
    for b in base:
        x = b
        for _ in range(4):  # chains of 1 to 5 changed bits
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            out.add(x)
    centre = base[0]
    for _ in range(300):  # a dense ball
        x = centre
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= 1 << int(bit)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("blocks", [THREE, TWO])
@pytest.mark.parametrize("rows_per_cell", [1 << 15, 40])
def test_links_join_what_is_close(spark, blocks, rows_per_cell, monkeypatch):
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", rows_per_cell)
    fps = planted(1)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(frame, blocks)).collect()}
    want = plain_components(fps)
    groups, mine = {}, {}
    for f, s in zip(fps, signed):
        groups.setdefault(want[f], set()).add(s)
        mine.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_every_point_is_within_reach_of_its_home():
    rng = np.random.default_rng(2)
    fps = rng.integers(-(2**63), 2**63 - 1, 500, dtype=np.int64)
    for block in (*THREE, *TWO):
        home, at, to = simhash.anchors(fps, block, simhash._errors(block))
        part = (fps >> block.shift) & ((1 << block.bits) - 1)
        assert (np.bitwise_count((home ^ part).view(np.uint64)) <= (1 if block.code else 0)).all()
        assert (np.bitwise_count((to ^ part[at]).view(np.uint64)) <= block.reach).all()
        assert (simhash._syndromes(home, block.code) == 0).all()


def test_blocks_that_miss_pairs_are_refused(spark):
    with pytest.raises(ValueError, match="miss"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), (THREE[0],))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 201)}


def test_keep_first(spark):
    docs = messy(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    comp = plain_components(sorted({plain_fingerprint(t) for _, t, *_ in rows()}))
    groups = {comp[plain_fingerprint(t)] for _, t, *_ in rows()}
    got = kept.select("doc_id", "text").distinct().collect()
    assert sorted(comp[plain_fingerprint(r.text)] for r in got) == sorted(groups)
    assert simhash.keep_first(empty(spark)).count() == 0
