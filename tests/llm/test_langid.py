import random
import zlib

import numpy as np

from frames import PROSE, empty, messy
from seafret.llm import langid


def corpus(spark, n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        words = PROSE[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 120))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_texts_are_told(spark):
    docs = corpus(spark)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    right = [got[r.doc_id].lang_pred == r.lang for r in docs.collect() if got[r.doc_id].held_out]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_and_other_columns_do_not_count(spark):
    from pyspark.sql import functions as F

    docs = corpus(spark)
    held = langid.is_held_out(F.col("doc_id"))
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.col("lang"))
    a = langid.identify(docs).orderBy("doc_id").collect()
    assert a == langid.identify(other).orderBy("doc_id").collect()


def test_windows_cover_the_whole_text():
    text = "ä" * 300 + "b" * 45
    x, count, used = langid.windows([text, "", "c"])
    assert count.tolist() == [3, 1, 1]
    assert bytes(x[:3].ravel()).rstrip(b"\0").decode() == text
    assert used.tolist() == [256, 256, 133, 1, 1]


def test_pair_tables_give_the_same_values():
    net = langid.ByteCnn(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (20, langid.WINDOW), dtype=np.uint8)
    act = np.maximum(net.pooled(x)[0], 0)
    z = act @ net.weights + net.bias
    e = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(net.probabilities(x), e / e.sum(axis=1, keepdims=True), atol=1e-5)


def test_messy(spark):
    docs = messy(spark)
    net = langid.fit(corpus(spark))
    got = langid.identify(docs, net).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.doc_id in (2, 3, 4, 7):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.doc_id: r.lang_pred for r in got}[10] == "en"
    kept = langid.keep_known(docs, net)
    assert kept.columns == docs.columns
    assert not {2, 3, 4, 7} & {r.doc_id for r in kept.collect()}
    assert {i for i in texts if i is not None and i >= 100} <= {r.doc_id for r in kept.collect()}


def test_empty_or_unlabelled(spark):
    assert langid.identify(empty(spark)).count() == 0
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first()[1:] in [(h, "und", 0.0) for h in (True, False)]


def test_numerals_are_no_letters(spark):
    texts = ["\u00b2 12", "\u2460 \u2461", "\u00bd", "\u2167", "_", "12 a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = langid.fit(frames_of(spark))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, net).collect()}
    assert [got[i] for i in range(5)] == ["und"] * 5 and got[5] != "und"


def frames_of(spark):
    from frames import PROSE

    return spark.createDataFrame([(i, f"{PROSE[k]} {i}", k) for i in range(60) for k in PROSE], "doc_id long, text string, lang string")


def test_a_repeated_row_does_not_fill_the_sample(spark, monkeypatch):
    docs = frames_of(spark)
    hot = spark.range(3000).selectExpr("cast(1 as long) as doc_id", "'le chat est sur le tapis' as text", "'fr' as lang")
    monkeypatch.setattr(langid, "FIT_PER_LANG", 20)
    seen = []
    real = langid.ByteCnn.fit
    monkeypatch.setattr(langid.ByteCnn, "fit", lambda self, x, y: seen.append((self.langs, y)) or real(self, x, y))
    langid.fit(docs.unionByName(hot))
    langs, y = seen[0]
    n = np.bincount(y)[langs.index("fr")]
    assert 10 <= n <= 20 * langid.FIT_WINDOWS  # texts here have one window
