"""Queries of quadrature rules, Chebyshev points and interpolation, values from roots and on grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import quadrature as q
from tessera.functions.series import BASES

QUERIES, ORACLES = {}, {}


def _add(name, table, run, sql):
    QUERIES[name] = lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    ORACLES[name] = sql


# The integral of x to each part's own power, up to degree 2 * 8 - 1, against its closed form; large ones by their logarithm.
_DOUBLE_FACTORIAL = "list_product([greatest(1, k - 1 - 2 * j)::DOUBLE FOR j IN range(12)])"
_CLOSED = {
    "leg": "CASE WHEN k % 2 = 1 THEN 0 ELSE 2e0 / (k + 1) END",
    "cheb": "CASE WHEN k % 2 = 1 THEN 0 ELSE pi() * coalesce(list_product([(2e0 * j + 1) / (2 * j + 2) FOR j IN range(k // 2)]), 1) END",
    "herm": "CASE WHEN k % 2 = 1 THEN 0 ELSE gamma((k + 1) / 2e0) END",
    "herme": f"CASE WHEN k % 2 = 1 THEN 0 ELSE sqrt(2 * pi()) * {_DOUBLE_FACTORIAL} END",
    "lag": "gamma(k + 1e0)",
}
for _name, _sql in _CLOSED.items():
    def _run(f, b=_name):
        k = F.col("p_size") % 16
        value = q.integrate(lambda x: F.pow(x, k), b, 8)
        return f.select("p_partkey", k.cast("long").alias("k"), value.alias("v"))

    QUERIES[f"{_name}gauss"] = lambda spark, sf_dir, r=_run: (
        r(spark.read.parquet(f"{sf_dir}/part.parquet")).select("p_partkey", (F.when(F.abs("v") < 0.5, F.round("v", 7)).otherwise(F.round(F.signum("v") * F.log(F.abs("v")), 9)) + 0.0).alias("y"))
    )
    ORACLES[f"{_name}gauss"] = f"SELECT p_partkey, (CASE WHEN abs(v) < 0.5 THEN round(v, 7) ELSE round(sign(v) * ln(abs(v)), 9) END) + 0.0 AS y FROM (SELECT p_partkey, ({_sql})::DOUBLE AS v FROM (SELECT p_partkey, (p_size % 16)::BIGINT AS k FROM part))"

_K = "(SELECT row_number() OVER () - 1 AS k, count(*) OVER () AS n FROM supplier)"
for _ends, _sql in ((False, "cos(pi() * (2 * (n - 1 - k) + 1) / (2 * n))"), (True, "cos(pi() * (n - 1 - k) / (n - 1))")):
    _add(
        f"chebpts{1 + _ends}",
        "supplier",
        lambda f, e=_ends: (lambda p: f.sparkSession.range(len(p)).select(F.col("id").alias("pos"), (F.round(F.get(F.array(*[F.lit(v) for v in p]), F.col("id").cast("int")), 9) + 0.0).alias("x")))(q.chebyshev_points(f.count(), e)),
        f"SELECT k AS pos, round({_sql}, 9) + 0.0 AS x FROM {_K}",
    )
_a, _b, _c = "p_size / 7e0", "(p_partkey % 11 - 5)::DOUBLE", "(p_partkey % 4 - 1.5)::DOUBLE"
_row = lambda: [(F.col("p_size") / 7.0), (F.col("p_partkey") % 11 - 5).cast("double"), (F.col("p_partkey") % 4 - 1.5).cast("double")]


def _interpolated(f):
    a, b, c = _row()
    made = q.chebyshev_interpolate(lambda x: a + b * x + c * x * x * x, 5)
    return f.select("p_partkey", F.posexplode(made).alias("k", "y")).select("p_partkey", "k", (F.round("y", 8) + 0.0).alias("y"))


_add("chebinterpolate", "part", _interpolated, f"SELECT p_partkey, k::INTEGER AS k, round(CASE k WHEN 0 THEN {_a} WHEN 1 THEN {_b} + 0.75e0 * {_c} WHEN 3 THEN {_c} / 4e0 ELSE 0 END, 8) + 0.0 AS y FROM part, range(6) r(k)")
_add("polyvalfromroots", "part", lambda f: f.select("p_partkey", (F.round(q.value_from_roots(F.col("p_size") / 10.0, F.array(*_row())), 6) + 0.0).alias("y")),
     f"SELECT p_partkey, round((p_size / 10e0 - {_a}) * (p_size / 10e0 - {_b}) * (p_size / 10e0 - {_c}), 6) + 0.0 AS y FROM part")
_add("polycompanion", "part", lambda f: f.select("p_partkey", F.posexplode(q.companion([*_row(), F.lit(2.0)])).alias("i", "row")).select("p_partkey", "i", F.posexplode("row").alias("j", "x")).select("p_partkey", "i", "j", (F.round("x", 8) + 0.0).alias("x")),
     f"SELECT p_partkey, i::INTEGER AS i, j::INTEGER AS j, round((i = j + 1)::INTEGER - CASE WHEN j = 2 THEN CASE i WHEN 0 THEN {_a} WHEN 1 THEN {_b} ELSE {_c} END / 2 ELSE 0 END, 8) + 0.0 AS x FROM part, range(3) a(i), range(3) b(j)")

# Values on the grid of all nations' and regions' places, per basis.
_T = {
    "poly": ("1", "x", "x * x"), "cheb": ("1", "x", "2 * x * x - 1"), "leg": ("1", "x", "(3 * x * x - 1) / 2"),
    "herm": ("1", "2 * x", "4 * x * x - 2"), "herme": ("1", "x", "x * x - 1"), "lag": ("1", "1 - x", "(x * x - 4 * x + 2) / 2"),
}
_GRID = [[1.0, -2.0], [0.5, 3.0], [-1.5, 0.25]]
for _name, _terms in _T.items():
    _value = " + ".join(f"({_GRID[i][j]}) * ({_terms[i]}) * ({_terms[j].replace('x', 'y')})" for i in range(3) for j in range(2))
    QUERIES[f"{_name}grid2d"] = lambda spark, sf_dir, b=_name: (
        (lambda s, r: s.join(F.broadcast(r)).select("i", "j", (F.round(BASES[b].val2d(F.col("x"), F.col("y"), _GRID), 6) + 0.0).alias("v")))(
            spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("i"), ((F.col("s_suppkey") % 50) / 25.0 - 1).alias("x")),
            spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("j"), (F.col("r_regionkey") / 4.0).alias("y")).limit(5),
        )
    )
    ORACLES[f"{_name}grid2d"] = f"SELECT s_suppkey AS i, r_regionkey AS j, round({_value}, 6) + 0.0 AS v FROM (SELECT s_suppkey, (s_suppkey % 50) / 25e0 - 1 AS x FROM supplier), (SELECT r_regionkey, r_regionkey / 4e0 AS y FROM region)"
