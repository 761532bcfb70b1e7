"""What only shows on larger tables than the others': one test for each finding, on the rows that showed it."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.distributions import Draws
from tessera.operators import axes, blocks, tensor
from tessera.plans import blocks as block_plans
from tessera.plans import elementwise, frames, random, raw


def test_fmod_of_quotients_less_a_decimal(spark, tmp_path):
    rows = [(1000, 23, 900.0), (1500, 19, 950.0), (3500, 24, 950.0), (15250, 13, 925.0)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = elementwise.QUERIES["ufunc_fmod"](spark, str(tmp_path)).orderBy("p_partkey").collect()
    part = duckdb.from_parquet(f"{tmp_path}/part.parquet/*.parquet")  # noqa: F841
    assert [tuple(r) for r in got] == duckdb.sql(elementwise.ORACLES["ufunc_fmod"] + " ORDER BY p_partkey").fetchall()
    assert [r.y for r in got] == [-0.15, -0.55, -0.05, -1.15]


def test_tobytes_multiplies_floats_as_floats(spark, tmp_path):
    values = [0.29, 0.57, 1.13, -0.07, 0.18]  # the first four are below these numbers as floats, and a hundred times them round up to whole ones
    spark.createDataFrame([(1, values)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    embeddings = duckdb.from_parquet(f"{tmp_path}/embeddings.parquet/*.parquet")  # noqa: F841
    wanted = duckdb.sql(raw.ORACLES["tobytes"]).fetchall()
    kept = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):  # under ANSI rules a float times an integer is a double
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            assert [tuple(r) for r in raw.QUERIES["tobytes"](spark, str(tmp_path)).collect()] == wanted
    finally:
        spark.conf.set("spark.sql.ansi.enabled", kept)


def test_einsum_chain_beyond_64_bits(spark, tmp_path):
    lines = [(n, 3 * n + 1, n * n, 2_000_000_000 - n) for n in range(40)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    lineitem = duckdb.from_parquet(f"{tmp_path}/lineitem.parquet/*.parquet")  # noqa: F841
    exact = frames.ORACLES["einsum_chain"].replace("::BIGINT", "")  # the cast raises at this size
    got = frames.QUERIES["einsum_chain"](spark, str(tmp_path)).collect()
    assert sorted((r.i, r.l, int(r.x)) for r in got) == sorted(duckdb.sql(exact).fetchall()) and max(r.x for r in got) > 1 << 80


def test_exact_products_stay_bigint_where_the_result_fits(spark):
    large = spark.createDataFrame([(0, 0, 1 << 62), (0, 1, -(1 << 62)), (1, 0, 3)], "i long, j long, x long")
    other = spark.createDataFrame([(0, 0, 4), (1, 0, 4), (1, 1, 0)], "i long, j long, x long")
    cells = lambda f: sorted(tuple(r) for r in f.collect())
    for optimize in (False, True):
        made = tensor.einsum("ij,jk,kl->il", *[(f, ["i", "j"], "x") for f in (large, other, other)], optimize=optimize, exact=True)
        assert dict(made.dtypes)["x"] == "bigint" and cells(made) == [(0, 0, 0), (0, 1, 0), (1, 0, 48)]  # 2^64 less 2^64 on the way
    wide = tensor.einsum("ij,jk->ik", (large, ["i", "j"], "x"), (other.filter("i = 0"), ["i", "j"], "x"), exact=True)
    assert [(r.i, r.k, int(r.x)) for r in wide.orderBy("i").collect()] == [(0, 0, 1 << 64), (1, 0, 12)]
    assert cells(tensor.einsum("ij->", (large.limit(0), ["i", "j"], "x"), exact=True)) == [(None,)]
    halves = other.withColumn("x", F.col("x") / 2)
    assert dict(tensor.einsum("ij,jk->ik", (halves, ["i", "j"], "x"), (other, ["i", "j"], "x"), exact=True).dtypes)["x"] == "double"


def test_draws_stop_at_the_first_proposal(spark):
    late = Draws(F.col("id"))._first(lambda k: F.when(k == 2, k * 1.5).when(k > 2, F.raise_error("worked out").cast("double")))
    assert [r.y for r in spark.range(3).select(late.alias("y")).collect()] == [3.0] * 3


def _digests(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("md5(")


def test_beta_draws_each_gamma_once(spark, sf_dir):
    assert _digests(random.QUERIES["random_beta"](spark, sf_dir)) == 6  # two gammas of three uniforms


def test_dirichlet_draws_each_gamma_once(spark, sf_dir):
    assert _digests(random.QUERIES["random_dirichlet"](spark, sf_dir)) == 9  # three gammas of three uniforms


def test_f_draws_each_gamma_once(spark, sf_dir):
    assert _digests(random.QUERIES["random_f"](spark, sf_dir)) == 6  # two gammas of three uniforms


def test_noncentral_f_draws_each_gamma_once(spark, sf_dir):
    assert _digests(random.QUERIES["random_noncentral_f"](spark, sf_dir)) == 8  # two gammas of three uniforms and a normal of two


def test_outer_products_are_finished_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(37, 6)), rng.normal(size=(6, 29))
    framed = lambda m, keep: blocks.from_rows(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m) if i in keep], "i long, v array<double>"), "i", "v", m.shape, 4)
    left, right = framed(a, {*range(12), *range(16, 37)}), framed(b, range(6))
    whole = blocks.matmul(left, right)
    monkeypatch.setattr(blocks, "HELD", 4096)
    tiled = blocks.matmul(left, right)
    plan = tiled.frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("RepartitionByExpression") < plan.index("Union")  # no product travels
    cells = lambda m: {(r.i, r.j): r.x for r in blocks.to_coordinates(m).collect()}
    got, want = cells(tiled), cells(whole)
    assert got.keys() == want.keys() == {(i, j) for i in range(37) for j in range(29) if not 12 <= i < 16}
    np.testing.assert_allclose([got[k] for k in want], [(a @ b)[k] for k in want], atol=1e-12)
    monkeypatch.undo()
    for n in (2137, 12813, 80000):
        tall, wide = blocks.strips(n, 2, n, 48, 6)
        assert tall * wide >= 24 and n * wide + n * tall < n * n / 100 and (n / tall + n / wide) * 2 * 48 * 48 * 8 < 1.1 * blocks.HELD


def test_near_rounds_as_round(spark):
    values = [0.00005, -0.00005, 0.12344999, 1.5, -2.25, 0.0, -0.0, 1e305, float("inf"), float("nan"), None]
    got = block_plans._near(spark.createDataFrame([(0, k, x) for k, x in enumerate(values)], "i int, j int, x double"), 4).orderBy("j").collect()
    assert [str(r.x) for r in got] == ["0.0001", "-0.0001", "0.1234", "1.5", "-2.25", "0.0", "0.0", "1e+305", "inf", "nan", "None"]


@pytest.mark.parametrize("lower", [False, True])
def test_triangle_indices_pack_small(spark, tmp_path, lower):
    for n, k in ((0, 0), (1, 0), (1, 1), (300, 1), (257, -3), (40, 50), (40, -50), (256, 256)):
        got = axes.triangle_indices(spark, n, k, lower)
        want = np.tril_indices(n, k) if lower else np.triu_indices(n, k)
        assert got.dtypes == [("i", "bigint"), ("j", "bigint")] and sorted(map(tuple, got.collect())) == list(zip(*(x.tolist() for x in want)))
    made = axes.triangle_indices(spark, 3000, 1, lower)
    made.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3000 * 2999 // 2 + lower * (3000 + 2999)
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.3 * 3000 * 3000 / 2
