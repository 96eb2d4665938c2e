"""Exact dedup against a persistent digest index, bucketed and sorted by hash. DataFrame operations only.

Texts are equal when identical after each run of ASCII white space became one space; null counts as empty.
Null ids sort last, rows repeated with one id are told apart, an empty table gives an empty result, and other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seafret.llm.common import attach, bounded, text_of, without, written
from seafret.session import new_path

WHITE = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, WHITE, " "), 256)


class DigestIndex:
    """Digests seen so far with the id that stays, as a bucketed and sorted table at a path.

    The folder outlives the session. It holds the entries (`data`), the number of buckets and the rule of the digest (`meta`), and a
    row for every finished batch (`commits`). A session opens it with the stored number of buckets, whatever its own settings are;
    asking for another number is an error. Entries count once their batch is committed, so what a failed append
    left behind is never read, and a batch added again changes nothing and gets the same answer. One writer at a time.
    """

    RULE = "sha256 of text with ASCII white space runs as one space"
    META = "buckets int, rule string, generation int"
    COMMITS = "batch string, attempt string, generation int"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        stored = self._stored()
        if stored is None:
            made = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._note("commits", self.COMMITS)
            self._note("meta", self.META, made, self.RULE, 0)
            stored = self._stored()
        if stored["rule"] != self.RULE:
            raise ValueError(f"{path} holds digests by another rule: {stored['rule']}")
        if buckets and buckets != stored["buckets"]:
            raise ValueError(f"{path} has {stored['buckets']} buckets, not {buckets}")
        self.buckets = stored["buckets"]
        self._open(stored["generation"])

    def _stored(self):
        try:
            notes = self.spark.read.schema(self.META).parquet(f"{self.path}/meta")
            return notes.orderBy(F.desc("generation")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _note(self, kind: str, ddl: str, *values) -> None:
        """Append one row (none without values) to a small table of the index."""
        names = [c.split() for c in ddl.split(", ")]
        row = self.spark.range(1 if values else 0).select(*[F.lit(v).cast(t).alias(c) for (c, t), v in zip(names, values or [None] * len(names))])
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/{kind}")

    def _open(self, generation: int) -> None:
        self.generation = generation
        self.data = f"{self.path}/data-{generation}"
        self.name = "digest_index_" + hashlib.md5(self.data.encode()).hexdigest()[:16]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, batch STRING, attempt STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.data}'"
        )
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forget the table's name in the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def commits(self) -> DataFrame:
        return self.spark.read.schema(self.COMMITS).parquet(f"{self.path}/commits").filter(F.col("generation") == self.generation)

    def is_committed(self, batch: str) -> bool:
        return not self.commits().filter(F.col("batch") == batch).isEmpty()

    def table(self, but: str | None = None) -> DataFrame:
        """digest, keep_id of all committed batches, without the one called `but`."""
        finished = bounded(self.commits().select("attempt").distinct())
        rows = self.spark.table(self.name).join(finished, "attempt", "left_semi")
        if but is not None:
            rows = rows.filter(F.col("batch") != but)
        return rows.select("digest", "keep_id")

    def add(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Append the digests that no other batch has brought (one row each: digest, keep_id); returns them."""
        batch, attempt = batch or uuid.uuid4().hex, uuid.uuid4().hex
        fresh = written(digests.select("digest", "keep_id").hint("merge").join(self.table(batch), "digest", "left_anti"), "fresh-digests")
        if not self.is_committed(batch):
            self._append(fresh.withColumns({"batch": F.lit(batch), "attempt": F.lit(attempt)}))
            self._note("commits", self.COMMITS, batch, attempt, self.generation)
        return fresh

    def _append(self, rows: DataFrame) -> None:
        (
            rows.select("digest", "keep_id", "batch", "attempt")
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .format("parquet")
            .option("path", self.data)
            .saveAsTable(self.name)
        )

    def compact(self) -> None:
        """Rewrite all committed entries as one sorted file per bucket, as the next generation; what failed appends left goes."""
        finished = self.commits()
        rows = self.spark.table(self.name).join(bounded(finished.select("attempt").distinct()), "attempt", "left_semi")
        told = finished.select("batch", "attempt").withColumn("generation", F.lit(self.generation + 1))
        rows, told = written(rows, "compacted"), written(told, "compacted-commits")
        self.close()
        self._open(self.generation + 1)
        self._append(rows)
        told.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        # until this row is there the old generation counts
        self._note("meta", self.META, self.buckets, self.RULE, self.generation)


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text_of()).alias("digest"), *more)
    return written(named.withColumn("row_id", F.monotonically_increasing_id()), "digests")


def _groups(rows: DataFrame, *by: str) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
    return written(
        rows.groupBy("digest", *by)
        .agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", *by, F.col("first.doc_id").alias("keep_id"), F.col("first.row_id").alias("keep_row"), "group_size"),
        "digest-groups",
    )


def _told(groups: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """digest, keep_id, keep_row (null if the index knew the text before this batch), group_size; adds the new texts."""
    fresh = index.add(groups, batch).select("digest", F.lit(True).alias("fresh"))
    known = index.table(batch).select("digest", F.col("keep_id").alias("known_id"))
    # the index answers for texts of other batches, the anti-join for the rest
    told = groups.hint("merge").join(fresh, "digest", "left").join(known, "digest", "left")
    return written(
        told.select(
            "digest", F.when(F.col("fresh"), F.col("keep_id")).otherwise(F.col("known_id")).alias("keep_id"),
            F.when(F.col("fresh"), F.col("keep_row")).alias("keep_row"), "group_size",
        ),
        "digest-told",
    )


def _answered(rows: DataFrame, told: DataFrame) -> DataFrame:
    kept = F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False))
    return attach(rows, told, "digest", "group_size").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Without an index the table stands alone. With one, a text that an earlier batch brought is dropped in favour of the
    id stored there, and the other texts are added under the name `batch`; the same batch again gives the same rows. group_size
    counts rows of this table.
    """
    mine = index or DigestIndex(docs.sparkSession, new_path(docs.sparkSession, "llm-index"))
    rows = _rows(docs)
    told = _told(_groups(rows), mine, batch or uuid.uuid4().hex)
    if index is None:
        mine.close()
    return _answered(rows, told)


def dedup_in_two(docs: DataFrame) -> DataFrame:
    """The result of `dedup` on a whole table, worked out as an index is used: the rows of the smaller ids are indexed first, then the
    others are anti-joined to them and appended. As smaller ids come first, of equal texts the smallest id stays."""
    spark = docs.sparkSession
    ends = docs.agg(F.min(F.col("doc_id").cast("long")).alias("a"), F.max(F.col("doc_id").cast("long")).alias("b")).first()
    cut = None if ends["a"] is None else ends["a"] + (ends["b"] - ends["a"]) // 2
    late = F.coalesce(F.col("doc_id") > F.lit(cut).cast("long"), F.lit(True))
    rows = _rows(docs, late.alias("late"))
    groups = _groups(rows, "late")
    index = DigestIndex(spark, new_path(spark, "llm-index"))
    parts = [_told(groups.filter(F.col("late") == second).drop("late"), index, f"half-{int(second)}") for second in (False, True)]
    index.close()
    both = parts[0].unionByName(parts[1])
    # a text of both halves: the index gave its id to the second one
    told = both.groupBy("digest").agg(
        F.min(F.struct(F.col("keep_id").isNull().alias("no_id"), "keep_id")).alias("first"), F.max("keep_row").alias("keep_row"), F.sum("group_size").alias("group_size")
    )
    told = written(told.select("digest", F.col("first.keep_id").alias("keep_id"), "keep_row", "group_size"), "digest-both")
    return _answered(rows.drop("late"), told)


def keep_first(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of whole repeated rows (id and text) one stays."""
    told = written(dedup(docs, index, batch), "exact-dedup")
    # a repeated row shares id and digest with the row that stays: it goes by dropping duplicates
    gone = told.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = written(gone.filter(~F.col("stays") | (F.col("n") > 1)), "exact-gone")
    mark = digest(text_of())
    left = without(docs, gone.filter(~F.col("stays")), {"doc_id": F.col("doc_id"), "text_sha256": mark})
    again = gone.filter("stays")
    if again.isEmpty():
        return left
    single = without(left, again, {"doc_id": F.col("doc_id"), "text_sha256": mark})
    multiple = left.join(
        again.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")),
        F.col("doc_id").eqNullSafe(F.col("__id")) & (mark == F.col("__sha")),
        "left_semi",
    )
    one = multiple.withColumn("__sha", mark).dropDuplicates(["doc_id", "__sha"]).select(*docs.columns)
    return single.unionByName(one)
