"""Queries of equations, inverses and determinants of matrices made from every part; each tenth part's is singular."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import elimination

QUERIES, ORACLES = {}, {}


def _add(name, run, sql):
    QUERIES[name] = lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/part.parquet"))
    ORACLES[name] = sql


def _cell(i: int, j: int, n: int) -> str:
    """SQL of a cell; in each tenth part's matrix the last row repeats the first."""
    at = lambda i: f"((p_partkey * {i * 7 + j * 3 + 1}) % 11 - 5 + {9 * n if i == j else 0})"
    return f"CASE WHEN p_partkey % 10 = 0 THEN {at(0)} ELSE {at(i)} END" if i == n - 1 else at(i)


def _matrices(part, n):
    known = [f"(p_size + {k} * (p_partkey % 3 - 1))" for k in range(n)]
    rows = ", ".join("array(" + ", ".join(f"double({_cell(i, j, n)})" for j in range(n)) + ")" for i in range(n))
    side = ", ".join("double(" + " + ".join(f"({_cell(i, j, n)}) * {known[j]}" for j in range(n)) + ")" for i in range(n))
    return part.selectExpr("p_partkey", f"array({rows}) AS m", f"array({side}) AS b"), known


for _n in range(2, 7):
    _known = [f"(p_size + {k} * (p_partkey % 3 - 1))" for k in range(_n)]
    _add(
        f"solve_{_n}",
        lambda f, n=_n: elimination.solve(_matrices(f, n)[0], "m", "b").select("p_partkey", *[(F.round(F.get("x", F.lit(k)), 6) + 0.0).alias(f"x{k}") for k in range(n)]),
        "SELECT p_partkey, " + ", ".join(f"CASE WHEN p_partkey % 10 <> 0 THEN {e}::DOUBLE END AS x{k}" for k, e in enumerate(_known)) + " FROM part",
    )
_CELLS = "(SELECT p_partkey, " + ", ".join(f"({_cell(i, j, 3)})::DOUBLE AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM part)"
_minor = lambda i, j: (lambda r, c: f"(m{r[0]}{c[0]} * m{r[1]}{c[1]} - m{r[0]}{c[1]} * m{r[1]}{c[0]})")([k for k in range(3) if k != i], [k for k in range(3) if k != j])
_DET = f"(m00 * {_minor(0, 0)} - m01 * {_minor(0, 1)} + m02 * {_minor(0, 2)})"
_add("det_3", lambda f: elimination.det(_matrices(f, 3)[0], "m").select("p_partkey", (F.round("det", 3) + 0.0).alias("det")), f"SELECT p_partkey, round({_DET}, 3) + 0.0 AS det FROM {_CELLS}")
_add(
    "slogdet_3",
    lambda f: elimination.slogdet(_matrices(f, 3)[0].withColumn("m", F.expr("transform(m, (r, i) -> transform(r, x -> if(i = 0 and p_partkey % 2 = 0, -x, x)))")), "m").select("p_partkey", "sign", F.round("logabsdet", 8).alias("logabsdet")),
    f"SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0.0 WHEN p_partkey % 2 = 0 THEN -sign({_DET}) ELSE sign({_DET}) END::DOUBLE AS sign, CASE WHEN p_partkey % 10 = 0 THEN '-inf'::DOUBLE ELSE round(ln(abs({_DET})), 8) END AS logabsdet FROM {_CELLS}",
)
_add(
    "inv_3",
    lambda f: elimination.inv(_matrices(f, 3)[0], "m").select("p_partkey", *[(F.round(F.get(F.get("inverse", F.lit(i)), F.lit(j)), 9) + 0.0).alias(f"y{i}{j}") for i in range(3) for j in range(3)]),
    "SELECT p_partkey, " + ", ".join(f"CASE WHEN p_partkey % 10 <> 0 THEN round({'-' if (i + j) % 2 else ''}{_minor(j, i)} / {_DET}, 9) + 0.0 END AS y{i}{j}" for i in range(3) for j in range(3)) + f" FROM {_CELLS}",
)
