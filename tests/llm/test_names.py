"""Columns of the user's own that have the names of helpers come back as they were."""

from tessera.llm.html import extract_pages
from tessera.llm.mixing import mix_documents
from tessera.llm.neardup import MinHash, drop_near_duplicates
from tessera.llm.shared import fresh


def test_fresh_names(spark):
    frame = spark.createDataFrame([(1, 2)], "__A int, `__a_` int")
    assert fresh(frame, "__a", "__a", "b") == ["__a__", "__a___", "b"]


def test_mixing(spark):
    names = ["__key", "__cut", "__times", "__copy", "__epochs", "__source"]
    rows = [(i, f"word {i} " * (i % 4 + 1), "ab"[i % 2], *names) for i in range(20)]
    frame = spark.createDataFrame(rows, "`doc.id` long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = mix_documents(frame, "doc.id").collect()
    assert got and {tuple(r) for r in got} <= set(rows)


def test_near_duplicates(spark):
    rows = [(i, f"the same words stand in this text again and again {i // 2} {i // 2}", "mine") for i in range(6)]
    frame = spark.createDataFrame(rows, "`doc.id` long, text string, __dropped string")
    assert {tuple(r) for r in drop_near_duplicates(frame, MinHash(5, 80), "doc.id").collect()} == set(rows[::2])


def test_pages(spark):
    names = ["__host", "__of", "__wrapper", "__pages"]
    frame = spark.createDataFrame([(i, "http://a.example/", f"<article><p>text {i}</p></article>", *names) for i in range(4)], "page_id long, `u.rl` string, html string, " + ", ".join(f"{n} string" for n in names))
    got = extract_pages(frame, "u.rl").orderBy("page_id").collect()
    assert [(r.text, *(r[n] for n in names)) for r in got] == [(f"text {i}", *names) for i in range(4)]
