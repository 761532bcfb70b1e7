import math
import random

import duckdb
import numpy as np

from tessera.llm import topk
from tessera.llm.topk import products, top_k
from tessera.llm.topk_query import SQL, op4_exact_top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, is_query, k):
    good = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in good:
        if is_query(q):
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "GROUP", 8)
    rng = random.Random(3)
    near = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in near[i % 5]], "x") for i in range(300)]
    rows += [(1000 + i, near[0], "x") for i in range(120)] + [(1000, near[0], "x")]
    rows += [(2000, None, "x"), (2050, [1.0, None], "x"), (2100, [float("nan")], "x"), (2150, [float("inf")], "x"), (None, near[1], "x"), (2200, [], "x"), (2250, [3.0], "x"), (2300, [-900.0] * 6, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in top_k(docs, docs.filter("vec_id % 50 = 0")).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, 5)


def test_few_and_none(spark):
    docs = spark.createDataFrame([(0, [1.0], ""), (1, [2.0], "")], SCHEMA)
    assert [tuple(r) for r in top_k(docs, docs.filter("vec_id = 0")).collect()] == [(0, 1, 1, 131072)]
    assert top_k(docs.limit(0), docs).count() == 0 and top_k(docs, docs.limit(0)).count() == 0


def test_large_products():
    a = np.array([[1 << 30, 3]], dtype=np.int64)
    assert products(a, a)[0, 0] == (1 << 60) + 9


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = con.sql(f"select * from ({SQL}) order by 1, 2").fetchall()
    assert sorted(tuple(r) for r in op4_exact_top_k(spark, sf_dir).collect()) == want


def test_groups_stay_small_where_that_saves_copies():
    pivots = np.array([[float(100 * i), 0.0] for i in range(6)])
    counts, edges = np.full((6, 1), 50), np.array([np.inf])
    apart = {c: np.where(np.arange(6) == c, 0.0, np.inf) for c in range(6)}
    edges = np.array([10.0])
    groups = topk.plan_groups({c: 20 for c in range(6)}, apart, pivots, counts, edges)
    assert len(groups) == 6 and sum(copies for _, _, copies in groups) == 300  # each vector once, not six times
    everywhere = {c: np.zeros(6) for c in range(6)}
    groups = topk.plan_groups({c: 20 for c in range(6)}, everywhere, pivots, counts, edges)
    assert [sorted(g) for g, _, _ in groups] == [[0, 1, 2, 3, 4, 5]] and groups[0][2] == 300


def test_clustered_vectors_are_not_sent_everywhere(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = np.eye(8) * 50
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(0, 0.01, 8)]) for i in range(800)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = []
    monkeypatch.setattr(topk, "plan_groups", lambda *a, f=topk.plan_groups: sent.append(f(*a)) or sent[-1])
    got = sorted(tuple(r) for r in top_k(docs, docs.filter("vec_id % 20 = 0"), 3).collect())
    assert got == brute([(i, v, "") for i, v in rows], lambda i: i % 20 == 0, 3)
    assert sum(copies for _, _, copies in sent[0]) <= 900  # eight groups of queries, yet about one copy of a vector
