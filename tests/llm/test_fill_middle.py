"""Fill-in-middle against a brute-force version on whole strings."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from seafret.llm import fill_middle
from tests.llm.frames import empty, long_text, messy


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text: str) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def expected(docs):
    rows = [(*brute(r.doc_id, r.text), r.text) for r in docs.select("doc_id", "text").collect()]
    return sorted(((*r[:5], sha(r[5]), sha(r[6])) for r in rows), key=str)


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def mixed(spark):
    r = random.Random(7)
    parts = ["abc", "Zz", " ", "\n", "é", "语", "😀", "1", "<P", ">", "ñ", "K", "ſ", "\x00", "<M>"]
    rows = [(i, "".join(r.choice(parts[: 14 + (i % 9 == 0)]) for _ in range(r.randrange(60)))) for i in range(400)]
    return spark.createDataFrame(rows + [(1000, long_text()), (1001, "語" * 70_000), (1002, "a"), (1003, "é")], "doc_id long, text string")


@pytest.mark.parametrize("chunk", [3, 7, fill_middle.CHUNK])
def test_digests_equal_brute_force(spark, chunk):
    docs = mixed(spark) if chunk > 3 else mixed(spark).filter("doc_id < 1000")
    assert key(fill_middle.digests(docs, chunk=chunk).collect()) == expected(docs)


def test_messy_rows(spark):
    docs = messy(spark)
    got = key(fill_middle.digests(docs).collect())
    assert got == expected(docs)
    assert len(got) == docs.count()


def test_forms_all_occur(spark):
    forms = {r.form: r.n for r in fill_middle.digests(mixed(spark)).groupBy("form").count().withColumnRenamed("count", "n").collect()}
    assert set(forms) == {"plain", "psm", "spm"} and forms["psm"] > forms["spm"]


def test_empty_table(spark):
    assert fill_middle.digests(empty(spark)).collect() == []
    assert fill_middle.transform(empty(spark)).collect() == []


def test_whole_outputs_and_restoration(spark):
    docs = mixed(spark).unionByName(messy(spark).select("doc_id", "text"))
    outputs = fill_middle.transform(docs, chunk=11).cache()
    assert key(outputs.drop("row_id").collect()) == key(brute(r.doc_id, r.text) for r in docs.collect())
    restored = fill_middle.restore(outputs, chunk=5)
    assert key((r.doc_id, r.text) for r in restored.collect()) == key((r.doc_id, r.text or "") for r in docs.collect())


def test_one_exchange_and_two_sorts(spark):
    plan = fill_middle.digests(mixed(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 2
