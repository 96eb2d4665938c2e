"""Removal of lines that many sites share, by distinct-site spread.

Each line hash gets a HyperLogLog sketch of its sites, merged by aggregation. A line whose estimate is far from the threshold is
decided by it; for lines near the threshold the sites are counted exactly. Lines on at least `min_sites` sites are boilerplate and
are removed from all texts. Lines that occur fewer times than that, on any site, are left out before any sketch is made.

Lines are compared as they are, split at newlines; empty lines never go. A null site is no site. A null text stays null. Rows
repeated whole repeat their result. An empty table gives an empty result; other columns than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seafret.llm.common import attach, bounded, written

MIN_SITES = 5
#: Sketches have 2^LG registers (relative error about 1.04 / sqrt(2^LG), 1.6 %); near means within NEAR of the threshold.
LG = 12
NEAR = 0.2


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """line, spread, n of the lines (by hash) on at least `min_sites` sites."""
    lines = docs.select(F.col(f"`{site}`").cast("string").alias("site"), F.explode(F.split("text", "\n")).alias("text"))
    lines = lines.filter((F.col("text") != "") & F.col("site").isNotNull()).select("site", line_hash(F.col("text")).alias("line"))
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("least"), F.max("site").alias("most"))
    often = written(counted.filter((F.col("n") >= min_sites) & ((F.col("least") != F.col("most")) | F.lit(min_sites < 2))).select("line", "n"), "often")
    occurs = written(lines.join(bounded(often.select("line")), "line", "left_semi"), "line-sites")
    # every task sketches the lines it has; the sketches of a line, never its rows, meet in one place
    sketch = F.hll_sketch_agg("site", LG)
    spread = written(occurs.groupBy("line").agg(F.hll_sketch_estimate(sketch).alias("spread"), F.count(F.lit(1)).alias("n")), "line-spread")
    near = F.abs(F.col("spread") - min_sites) <= F.greatest(F.lit(NEAR * min_sites), F.lit(1.0))
    sure = spread.filter(~near & (F.col("spread") >= min_sites))
    exact = (
        occurs.join(bounded(spread.filter(near).select("line")), "line", "left_semi")
        .groupBy("line")
        .agg(F.countDistinct("site").alias("spread"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("spread") >= min_sites)
    )
    return sure.unionByName(exact)


def remove(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, text without boilerplate lines, n_lines of the original, n_removed."""
    found = written(boilerplate(docs, site, min_sites), "boilerplate")
    mark = F.xxhash64("text")
    lines = docs.select("doc_id", mark.alias("mark"), F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.col("line") != "")
    lines = lines.select("doc_id", "mark", "at", line_hash(F.col("line")).alias("line"))
    if found.count() <= 200_000:
        hits = lines.join(F.broadcast(found.select("line")), "line", "left_semi")
    else:
        hits = attach(lines, found, "line", "n").filter(F.col("spread").isNotNull())
    gone = written(hits.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("gone")), "line-places")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "gone")
    read = docs.select("doc_id", "text", mark.alias("mark"))
    joined = read.join(bounded(gone, 20_000), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    split = F.split("text", "\n")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    )
    return joined.select(
        "doc_id",
        left.alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
