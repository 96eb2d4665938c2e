import inspect

import corpus_pipeline
from frames import empty, messy
from seafret.llm import common


def test_stages_keep_the_columns(spark, tmp_path):
    docs = messy(spark).drop(*[c for c in messy(spark).columns if c in ("first",)])
    spark.createDataFrame([(0, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.written(stage(spark, docs, str(tmp_path)), name)
        assert kept.columns == docs.columns
        assert 0 < kept.count() <= before
        docs, before = kept, kept.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == before
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids))


def test_run_over_documents(spark, tmp_path):
    messy(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.count() > 10


def test_run_over_nothing(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_written_tables_lie_in_the_shared_folder(spark, tmp_path):
    df = common.written(spark.range(3).toDF("id"), "x")
    assert df.count() == 3
    assert "seafret" in df.inputFiles()[0]
    assert "localCheckpoint" not in inspect.getsource(common)


def test_attach_equals_a_plain_join(spark):
    rows = spark.range(4000).selectExpr("id", "if(id % 3 = 0, 0, id % 700) as k")
    groups = rows.filter("k < 500").groupBy("k").count().selectExpr("k", "count as size", "k * 2 as v")
    got = common.attach(rows, groups, "k", "size").select("id", "k", "v")
    want = rows.join(groups, "k", "left").select("id", "k", "v")
    assert got.count() == 4000
    assert got.exceptAll(want).count() == 0
