import hashlib
import re

import pytest
from frames import empty, messy, rows
from seafret.llm import exact_dedup
from seafret.session import new_path


def mark(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()


def test_against_brute_force(spark):
    got = exact_dedup.dedup(messy(spark)).collect()
    want = {}
    for doc_id, text, *_ in rows():
        want.setdefault(mark(text), []).append(doc_id)
    assert len(got) == len(rows())
    for r in got:
        ids = want[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(want)


def test_in_two_batches_against_brute_force(spark):
    docs = messy(spark)
    got = sorted((tuple(r) for r in exact_dedup.dedup_in_two(docs).collect()), key=str)
    one = sorted((tuple(r) for r in exact_dedup.dedup(docs).collect()), key=str)
    assert got == one and len(got) == len(rows())
    assert exact_dedup.dedup_in_two(empty(spark)).count() == 0


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_index_keeps_its_buckets(spark, partitions):
    path = new_path(spark, "index")
    docs = spark.range(400).selectExpr("id as doc_id", "concat('text ', id) as text")
    partitions(8)
    index = exact_dedup.DigestIndex(spark, path)
    assert exact_dedup.dedup(docs, index, "first").filter("kept").count() == 400
    for n in (4, 8, 200):
        index.close()  # as in a new session
        partitions(n)
        index = exact_dedup.DigestIndex(spark, path)
        assert index.buckets == 8
        assert exact_dedup.dedup(docs, index, f"again {n}").filter("kept").count() == 0
        assert index.table().count() == 400
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 16)


def test_a_batch_added_again_gives_the_same_rows(spark):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, text string")
    b = spark.createDataFrame([(4, "y"), (5, "z")], "doc_id long, text string")
    answer = lambda docs, batch: sorted(tuple(r) for r in exact_dedup.dedup(docs, index, batch).collect())
    first, second = answer(a, "a"), answer(b, "b")
    assert [r[3] for r in first] == [True, True, False] and [r[3] for r in second] == [False, True]
    assert answer(a, "a") == first and answer(b, "b") == second
    assert index.table().count() == 3
    index.compact()
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.generation == 1 and again.table().count() == 3
    assert answer(a, "a") == first and answer(b, "b") == second
    assert [r[3] for r in answer(a, "c")] == [False, False, False]


def test_an_append_that_failed_is_not_read(spark, monkeypatch):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    real = exact_dedup.DigestIndex._note

    def dies(self, *args):
        raise OSError("driver lost")

    monkeypatch.setattr(exact_dedup.DigestIndex, "_note", dies)
    with pytest.raises(OSError):
        exact_dedup.dedup(docs, index, "a")
    monkeypatch.setattr(exact_dedup.DigestIndex, "_note", real)
    assert index.table().count() == 0
    assert exact_dedup.dedup(docs, index, "a").filter("kept").count() == 2
    assert index.table().count() == 2


def test_rows_that_stay(spark):
    docs = messy(spark)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, mark(r.text)) for r in kept.collect()]
    assert sorted(m for _, m in got) == sorted({mark(t) for _, t, *_ in rows()})
    assert got.count((6, mark(rows()[5][1]))) == 1  # of two whole repeated rows
    assert len([1 for i, _ in got if i is None]) == 1


def test_empty(spark):
    assert exact_dedup.dedup(empty(spark)).count() == 0
    assert exact_dedup.keep_first(empty(spark)).count() == 0


def test_index_lasts_and_grows(spark):
    path = new_path(spark, "index")
    first = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(0, "a  b"), (7, "d"), (8, "d")], "doc_id long, text string")
    assert all(r.kept for r in exact_dedup.dedup(first, exact_dedup.DigestIndex(spark, path, 4)).collect())
    spark.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path, 4).name}")  # the files stay
    got = {r.doc_id: (r.kept, r.keep_id) for r in exact_dedup.dedup(second, exact_dedup.DigestIndex(spark, path, 4)).collect()}
    assert got == {0: (False, 1), 7: (True, 7), 8: (False, 7)}
    assert exact_dedup.DigestIndex(spark, path, 4).table().count() == 3


def test_large_group_is_not_shuffled_by_its_key(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', concat('text ', id)) as text")
    got = exact_dedup.dedup(docs)
    assert got.filter("kept").count() == 5000 - 1667 + 1
    assert got.filter("group_size = 1667 and keep_id = 0").count() == 1667
