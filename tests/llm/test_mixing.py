import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix_documents, mix_plan
from tessera.llm.mixing_query import SQL, op9_mix_sources

SCHEMA = "doc_id long, text string, source string, size string"


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share, stop what is above its cap, share the excess of those again: until none is above."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s] + 1e-9]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


ROWS = (
    [(i, "w " * (i % 9 + 1), "a", "x") for i in range(60)]
    + [(i, "word" if i % 2 else "two\twords", "b", None) for i in range(60, 64)]
    + [(70, None, None, "y"), (71, "", None, "y"), (72, "one two three", None, "y")]
    + [(80, "same row here", "c", "z")] * 7
    + [(None, "no id", "c", "z"), (90, "x" * 5000 + " y", "c", "z"), (91, "z " * 3000, "d", "z")]
)


def test_targets_and_budgets(spark):
    got = mix_plan(spark.createDataFrame(ROWS, SCHEMA)).toPandas()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, text, source, _ in ROWS:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    for source, mine in got.groupby(got.source.fillna("\0null")):
        name = None if source == "\0null" else source
        assert mine.target.iloc[0] == pytest.approx(want[name])
        assert abs(mine.taken.sum() - want[name]) <= 0.5
    assert (got.taken <= 3 * got["size"]).all()


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_plan(empty).count() == 0 and mix_documents(empty).count() == 0


def test_documents_are_whole_and_near_target(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = mix_documents(docs)
    assert got.columns == docs.columns
    assert {r.text for r in got.collect()} <= {r[1] for r in ROWS}
    a = got.filter("source = 'a'").select(F.sum(F.expr("size(split(trim(text), ' '))"))).first()[0]
    sizes = {}
    for _, text, source, _ in ROWS:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    assert abs(a - targets(sizes)["a"]) <= 5


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(f"select * from ({SQL}) order by doc_id").fetchall()
    got = [tuple(r) for r in op9_mix_sources(spark, sf_dir).orderBy("doc_id").collect()]
    assert got == want
