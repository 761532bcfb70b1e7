import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.fim import fill_in_middle, restored, units
from tessera.llm.fim_query import SQL, op11_fill_in_middle

GRAMMARS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+", "characters": r"[\s\S]"}
SCHEMA = "doc_id long, text string, units string, `draws` string, form int"
TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na\n\nb\r\n c d\x0b", "x <P> y\nz", "<M>", "<S>\n", "\U0001f600\n\U0001f601é\n", "word " * 30000, "l\n" * 20000, "tail\n\n"]


def plain(doc_id, text, seed="7", percent=100, spm=50, grammar=GRAMMARS["lines"]):
    """The transformation, row by row."""
    text = text or ""
    cut = re.findall(grammar, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(cut)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(cut[:lo]), "".join(cut[lo:hi]), "".join(cut[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"percent": 40, "percent_spm": 20, "seed": "s"}])
@pytest.mark.parametrize("unit", sorted(GRAMMARS))
def test_matches_plain_version_and_comes_back(spark, unit, options):
    rows = [(i * 7, t, "u", "d", 1) for i, t in enumerate(TEXTS)] + [(None, "no\nid\n", None, None, None)] + [(5, "same\nrow", "u", "d", 1)] * 3
    frame = spark.createDataFrame(rows, SCHEMA)
    made = fill_in_middle(frame, unit=unit, **options).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = [(r[0], *plain(r[0], r[1], options.get("seed", "7"), options.get("percent", 100), options.get("percent_spm", 50), GRAMMARS[unit]), r[1] or "") for r in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, made), key=key) == sorted(want, key=key)


def test_units_of_any_text(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0")), min_size=20, max_size=40))
    def check(texts):
        frame = spark.createDataFrame([(t,) for t in texts], "t string")
        for unit, grammar in GRAMMARS.items():
            for row in frame.select("t", units(F.col("t"), unit).alias("u")).collect():
                assert row.u == re.findall(grammar, row.t)

    check()


def test_paragraphs_join_again(spark):
    frame = spark.createDataFrame([("a\n\nb\nc\n\n\n\nd",), ("\n\n",), ("x",)], "t string")
    got = [r[0] for r in frame.select(units(F.col("t"), "paragraphs")).collect()]
    assert got == [["a\n\n", "b\nc\n\n\n\n", "d"], ["\n\n"], ["x"]]


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    names = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    want = con.sql(f"select {names} from ({SQL}) order by doc_id, output_sha256").fetchall()
    assert [tuple(r) for r in op11_fill_in_middle(spark, sf_dir).orderBy("doc_id", "output_sha256").collect()] == want
    assert {r[2] for r in want} >= {"psm", "spm"}


def test_no_shuffle_and_two_columns(spark, sf_dir):
    plan = op11_fill_in_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
