"""Queries of comparisons that raise, and of matrix factors put together again; the SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dense
from tessera.operators import assertions
from tessera.plans.series import OFF_TIES

QUERIES, ORACLES = {}, {}


def _add(name, run, sql):
    QUERIES[name] = lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/part.parquet"))
    ORACLES[name] = sql


# Retail prices against prices that are off by little, by more, or absent.
_OFF = "(CASE p_size % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 1e-9 WHEN 2 THEN 2e-4 ELSE 0.5e0 END)"
_here = lambda f: f.select("p_partkey", F.col("p_retailprice").cast("double").alias("x"))
_there = lambda f: f.filter("p_size <> 30").select("p_partkey", F.expr(f"p_retailprice + {_OFF}").alias("x"))
_X, _Y = "p_retailprice::DOUBLE", f"(p_retailprice + {_OFF})"
_UNIT = f"pow(2, floor(log2(greatest({_X}, {_Y}))) - 52)"
_TESTS = {
    "array_equal": (assertions.equal, f"{_X} = {_Y}"),
    "equal": (assertions.equal, f"{_X} = {_Y}"),
    "allclose": (assertions.close(1e-6, 1e-5), f"abs({_X} - {_Y}) <= 1e-5 + 1e-6 * {_Y}"),
    "array_almost_equal": (assertions.almost(3), f"abs({_X} - {_Y}) < 1.5e-3"),
    "almost_equal": (assertions.almost(7), f"abs({_X} - {_Y}) < 1.5e-7"),
    "approx_equal": (assertions.approx(5), f"abs({_X} - {_Y}) / pow(10, floor(log10(({_X} + {_Y}) / 2))) < 1e-4"),
    "array_less": (assertions.less, f"{_X} < {_Y}"),
    "array_max_ulp": (assertions.within_units(100), f"abs({_X} - {_Y}) <= 100 * {_UNIT}"),
    "array_almost_equal_nulp": (assertions.within_units(1e6), f"abs({_X} - {_Y}) <= 1e6 * {_UNIT}"),
}
for _name, (_agrees, _sql) in _TESTS.items():
    _add(f"assert_{_name}", lambda f, g=_agrees: assertions.mismatches(_here(f), _there(f), ["p_partkey"], g).select("p_partkey"), f"SELECT p_partkey FROM part WHERE p_size = 30 OR NOT ({_sql})")

# Symmetric and other 2 x 2 matrices: factors, multiplied, give the matrix back.
_M = "(SELECT p_partkey, p_size + 10e0 AS a, p_partkey % 7 - 3e0 AS b, p_partkey % 5 + 0e0 AS c, p_partkey % 11 + 20e0 AS d FROM part)"
_general = lambda f: f.select("p_partkey", F.array(F.col("p_size") + 10.0, F.col("p_partkey") % 7 - 3.0, F.col("p_partkey") % 5 + 0.0, F.col("p_partkey") % 11 + 20.0).alias("m"))
_symmetric = lambda f: f.select("p_partkey", F.array(F.col("p_size") + 10.0, F.col("p_partkey") % 7 - 3.0, F.col("p_partkey") % 7 - 3.0, F.col("p_partkey") % 11 + 20.0).alias("m"))
_PRODUCTS = {
    "qr": (_general, "array(y[0] * y[4] + y[1] * y[6], y[0] * y[5] + y[1] * y[7], y[2] * y[4] + y[3] * y[6], y[2] * y[5] + y[3] * y[7])", "[a, b, c, d]"),
    "svd": (_general, "array(y[0] * y[4] * y[6] + y[1] * y[5] * y[8], y[0] * y[4] * y[7] + y[1] * y[5] * y[9], y[2] * y[4] * y[6] + y[3] * y[5] * y[8], y[2] * y[4] * y[7] + y[3] * y[5] * y[9])", "[a, b, c, d]"),
    "eigh": (_symmetric, "array(y[0] * y[2] * y[2] + y[1] * y[3] * y[3], y[0] * y[2] * y[4] + y[1] * y[3] * y[5], y[0] * y[2] * y[4] + y[1] * y[3] * y[5], y[0] * y[4] * y[4] + y[1] * y[5] * y[5])", "[a, b, b, d]"),
}
for _name, (_matrix, _product, _entries) in _PRODUCTS.items():
    _add(f"linalg_{_name}", lambda f, n=_name, m=_matrix, p=_product: dense.kernel(m(f), n, "m").select("p_partkey", F.posexplode(F.expr(p)).alias("j", "y")).withColumn("y", F.round("y", 6) + 0.0), f"SELECT p_partkey, k::INTEGER AS j, {_entries}[k + 1] AS y FROM {_M}, range(4) r(k)")
_ROOT = "sqrt(pow(a * a + b * b + c * c + d * d, 2) - 4 * pow(a * d - b * c, 2))"
_HIGH, _LOW = (f"sqrt(greatest((a * a + b * b + c * c + d * d {s} {_ROOT}) / 2, 0))" for s in "+-")
_SCALARS = {
    "norm_fro": "sqrt(a * a + b * b + c * c + d * d)", "norm_2": _HIGH, "norm_-2": _LOW, "norm_nuc": f"{_HIGH} + {_LOW}", "norm_1": "greatest(a + c, abs(b) + d)",
    "norm_-1": "least(a + c, abs(b) + d)", "norm_inf": "greatest(a + abs(b), c + d)", "norm_-inf": "least(a + abs(b), c + d)", "cond": f"{_HIGH} / {_LOW}",
    "slogdet": "ln(abs(a * d - b * c))", "slogdet_sign": "sign(a * d - b * c)::DOUBLE", "matrix_rank": "2e0",
}
for _name, _sql in _SCALARS.items():
    _add(f"linalg_{_name.replace('_-', '_smallest_')}", lambda f, n=_name: dense.kernel(_general(f), n, "m").select("p_partkey", F.round("y", 5).alias("y")), f"SELECT p_partkey, round({_sql}, 5) AS y FROM {_M}")
_add("linalg_svdvals", lambda f: dense.kernel(_general(f), "svdvals", "m").select("p_partkey", F.round(F.col("y")[0], 5).alias("high"), F.round(F.col("y")[1], 5).alias("low")), f"SELECT p_partkey, round({_HIGH}, 5) AS high, round({_LOW}, 5) AS low FROM {_M}")
_add("linalg_pinv", lambda f: dense.kernel(_general(f), "pinv", "m").select("p_partkey", F.posexplode("y").alias("j", "y")).withColumn("y", F.round(F.col("y") * OFF_TIES, 7) + 0.0), f"SELECT p_partkey, k::INTEGER AS j, round([d, -b, -c, a][k + 1] / (a * d - b * c) * {OFF_TIES}::DOUBLE, 7) + 0.0 AS y FROM {_M}, range(4) r(k)")
# Eigenvalues, which are two real ones or a pair: their sum is the trace, their product the determinant; A * v = w * v by both.
_add("linalg_eigvals", lambda f: dense.kernel(_general(f), "eigvals", "m").select("p_partkey", F.round(F.expr("y[0].re + y[1].re"), 5).alias("total"), F.round(F.expr("y[0].re * y[1].re - y[0].im * y[1].im"), 4).alias("product")), f"SELECT p_partkey, round(a + d, 5) AS total, round(a * d - b * c, 4) AS product FROM {_M}")
_RESIDUAL = "abs(m[{0}] * y[{1}].re + m[{2}] * y[{3}].re - (y[{4}].re * y[{5}].re - y[{4}].im * y[{5}].im))"
_add("linalg_eig", lambda f: dense.kernel(_general(f), "eig", "m").select("p_partkey", F.expr(" + ".join(_RESIDUAL.format(2 * i, 2 + k, 2 * i + 1, 4 + k, k, 2 + 2 * i + k) for i in range(2) for k in range(2)) + " < 1e-8").alias("holds")), "SELECT p_partkey, true AS holds FROM part")
