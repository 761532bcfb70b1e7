"""Queries of masked arrays over parts: x is masked on every seventh size, y on every fifth key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import masked_math as ma

QUERIES, ORACLES = {}, {}

_X, _Y = "CASE WHEN p_size % 7 <> 0 THEN (p_size - 25) / 10e0 END", "CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 11 - 5) / 2e0 END"
_FROM = f"(SELECT p_partkey, p_brand, p_size, {_X} AS x, {_Y} AS y, p_size % 7 AS i, p_partkey % 6 AS j FROM part)"


def parts(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    x = F.when(F.col("p_size") % 7 != 0, (F.col("p_size") - 25) / 10.0)
    y = F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 11 - 5) / 2.0)
    return part.select("p_partkey", "p_brand", "p_size", x.alias("x"), y.alias("y"), (F.col("p_size") % 7).alias("i"), (F.col("p_partkey") % 6).alias("j"))


def _add(name, run, sql):
    QUERIES[f"ma_{name}"] = lambda spark, sf_dir: run(parts(spark, sf_dir))
    ORACLES[f"ma_{name}"] = sql.replace("PARTS", _FROM)


def _even(column):
    return F.round(column, 8) + F.lit(0.0)


# One value for each part.
_UNARY = {
    "sqrt": "CASE WHEN x >= 0 THEN sqrt(x) END", "log": "CASE WHEN x > 0 THEN ln(x) END", "log2": "CASE WHEN x > 0 THEN log2(x) END", "log10": "CASE WHEN x > 0 THEN log10(x) END",
    "arcsin": "CASE WHEN abs(x) <= 1 THEN asin(x) END", "arccos": "CASE WHEN abs(x) <= 1 THEN acos(x) END", "arccosh": "CASE WHEN x >= 1 THEN acosh(x) END",
    "arctanh": "CASE WHEN abs(x) < 1 THEN atanh(x) END", "tan": "tan(x)", "exp": "exp(x)", "sin": "sin(x)", "cos": "cos(x)", "arctan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)",
    "tanh": "tanh(x)", "arcsinh": "asinh(x)", "absolute": "abs(x)", "abs": "abs(x)", "fabs": "abs(x)", "floor": "floor(x)", "ceil": "ceil(x)", "negative": "-x", "conjugate": "x",
    "around": "round_even(x, 0)", "round_": "round_even(x, 0)", "round": "round_even(x, 0)", "angle": "CASE WHEN x < 0 THEN pi() WHEN x IS NOT NULL THEN 0 END",
}
for _name, _sql in _UNARY.items():
    _add(_name, lambda f, n=_name: f.select("p_partkey", _even(ma.UNARY[n](F.col("x"))).alias("z")), f"SELECT p_partkey, round(({_sql})::DOUBLE, 8) + 0.0 AS z FROM PARTS")
_add("logical_not", lambda f: f.select("p_partkey", ma.UNARY["logical_not"](F.col("x")).alias("z")), "SELECT p_partkey, x = 0 AS z FROM PARTS")

_REST = "CASE WHEN x % y <> 0 AND (x % y < 0) <> (y < 0) THEN x % y + y ELSE x % y END"
_BINARY = {
    "add": "x + y", "subtract": "x - y", "multiply": "x * y", "divide": "CASE WHEN y <> 0 THEN x / y END", "true_divide": "CASE WHEN y <> 0 THEN x / y END",
    "floor_divide": f"CASE WHEN y <> 0 THEN round((x - {_REST}) / y) END", "remainder": f"CASE WHEN y <> 0 THEN {_REST} END", "mod": f"CASE WHEN y <> 0 THEN {_REST} END",
    "fmod": "CASE WHEN y <> 0 THEN x % y END", "power": "CASE WHEN x >= 0 AND (x > 0 OR y >= 0) OR y = floor(y) AND (x <> 0 OR y >= 0) THEN pow(x, y) END",
    "maximum": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END", "minimum": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END",
    "hypot": "sqrt(x * x + y * y)", "arctan2": "atan2(x, y)",
}
for _name, _sql in _BINARY.items():
    _digits = 6 if _name in ("remainder", "mod", "fmod", "power") else 8
    _add(_name, lambda f, n=_name, d=_digits: f.select("p_partkey", (F.round(ma.BINARY[n](F.col("x"), F.col("y")), d) + 0.0).alias("z")), f"SELECT p_partkey, round(({_sql})::DOUBLE, {_digits}) + 0.0 AS z FROM PARTS")
_TRUTHS = {
    "equal": "x = y", "not_equal": "x <> y", "less": "x < y", "less_equal": "x <= y", "greater": "x > y", "greater_equal": "x >= y",
    "logical_and": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x <> 0 AND y <> 0 END", "logical_or": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x <> 0 OR y <> 0 END",
    "logical_xor": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN (x <> 0) <> (y <> 0) END",
}
for _name, _sql in _TRUTHS.items():
    _add(_name, lambda f, n=_name: f.select("p_partkey", ma.BINARY[n](F.col("x"), F.col("y")).alias("z")), f"SELECT p_partkey, {_sql} AS z FROM PARTS")
_LONGS = lambda f: (F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("long")), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 9))
for _name, _sql in {"bitwise_and": "a & b", "bitwise_or": "a | b", "bitwise_xor": "xor(a, b)", "left_shift": "a << b", "right_shift": "a >> b"}.items():
    _add(_name, lambda f, n=_name: f.select("p_partkey", ma.INTEGER[n](*_LONGS(f)).alias("z")), f"SELECT p_partkey, {_sql} AS z FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size::BIGINT END AS a, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 9 END AS b FROM PARTS)")
for _name, _sql in {"masked_equal": "<>", "masked_not_equal": "=", "masked_greater": "<=", "masked_greater_equal": "<", "masked_less": ">=", "masked_less_equal": ">", "masked_object": "<>"}.items():
    _add(_name, lambda f, n=_name: f.select("p_partkey", ma.COMPARED[n](F.col("x"), 0.5).alias("z")), f"SELECT p_partkey, CASE WHEN x {_sql} 0.5 THEN x END AS z FROM PARTS")
_add("fix_invalid", lambda f: f.select("p_partkey", ma.fix_invalid(F.col("x") / F.nullif(F.col("y"), F.lit(0.0)), F.col("x") > 2).alias("z")).withColumn("z", _even(F.col("z"))), "SELECT p_partkey, CASE WHEN coalesce(x, 0) <= 2 AND y <> 0 THEN round(x / y, 8) + 0.0 END AS z FROM PARTS")
_add("putmask", lambda f: f.select("p_partkey", ma.put(F.col("x"), F.col("p_size") > 30, -1.0).alias("z")), "SELECT p_partkey, CASE WHEN p_size > 30 THEN -1.0::DOUBLE ELSE x END AS z FROM PARTS")
_add("harden_mask", lambda f: f.select("p_partkey", ma.put(F.col("x"), F.col("p_size") > 30, -1.0, True).alias("z")), "SELECT p_partkey, CASE WHEN p_size > 30 AND x IS NOT NULL THEN -1.0::DOUBLE ELSE x END AS z FROM PARTS")

# Reductions by brand.
_REDUCED = {
    "sum": "sum(x)", "mean": "avg(x)", "var": "var_pop(x)", "variance": "var_pop(x)", "std": "stddev_pop(x)", "max": "max(x)", "amax": "max(x)", "min": "min(x)", "amin": "min(x)",
    "ptp": "max(x) - min(x)", "median": "median(x)",
}
for _name, _sql in _REDUCED.items():
    _add(_name, lambda f, n=_name: ma.reduce(f, n, "x", ["p_brand"], "z").withColumn("z", F.round("z", 6) + 0.0), f"SELECT p_brand, round(({_sql})::DOUBLE, 6) + 0.0 AS z FROM PARTS GROUP BY p_brand")
for _name in ("prod", "product"):
    _add(_name, lambda f, n=_name: ma.reduce(f.withColumn("x", F.when(F.col("x") > 0, F.lit(1.0)).when(F.col("x") <= 0, F.lit(-1.0))), n, "x", ["p_brand"], "z"), "SELECT p_brand, product(CASE WHEN x > 0 THEN 1.0 WHEN x <= 0 THEN -1.0 END)::DOUBLE AS z FROM PARTS GROUP BY p_brand")
for _name, _sql in {"all": "bool_and(x <> 0)", "alltrue": "bool_and(x <> 0)", "any": "bool_or(x <> 0)", "sometrue": "bool_or(x <> 0)", "count": "count(x)", "count_masked": "count(*) - count(x)", "is_masked": "bool_or(x IS NULL)"}.items():
    _add(_name, lambda f, n=_name: ma.reduce(f, n, "x", ["p_brand"], "z"), f"SELECT p_brand, {_sql} AS z FROM PARTS GROUP BY p_brand")
_add("argmax", lambda f: ma.arg_extreme(f, "x", "p_partkey", ["p_brand"], True), "SELECT p_brand, arg_max(p_partkey, (x, -p_partkey)) FILTER (x IS NOT NULL) AS position FROM PARTS GROUP BY p_brand")
_add("argmin", lambda f: ma.arg_extreme(f, "x", "p_partkey", ["p_brand"], False), "SELECT p_brand, arg_min(p_partkey, (x, p_partkey)) FILTER (x IS NOT NULL) AS position FROM PARTS GROUP BY p_brand")
_add("average", lambda f: ma.average(f.withColumn("w", F.col("p_size").cast("double")), "x", "w", ["p_brand"], "z").withColumn("z", _even(F.col("z"))), "SELECT p_brand, round(sum(x * p_size) / sum(p_size) FILTER (x IS NOT NULL), 8) + 0.0 AS z FROM PARTS GROUP BY p_brand")
_add("cov", lambda f: ma.moments(f, "x", "y", ["p_brand"]).select("p_brand", _even(F.col("cov")).alias("z")), "SELECT p_brand, round(covar_samp(x, y), 8) + 0.0 AS z FROM PARTS GROUP BY p_brand")
_add("corrcoef", lambda f: ma.moments(f, "x", "y", []).select(_even(F.col("corrcoef")).alias("z")), "SELECT round(corr(x, y), 8) + 0.0 AS z FROM PARTS")
for _name in ("dot", "inner", "innerproduct"):
    _add(_name, lambda f: ma.dot(f, "x", "y", ["p_brand"], "z").withColumn("z", F.round("z", 6) + 0.0), "SELECT p_brand, round(coalesce(sum(x * y), 0), 6) + 0.0 AS z FROM PARTS GROUP BY p_brand")
_add("polyfit", lambda f: ma.polyfit(f, "x", "y", []).select(F.round("slope", 8).alias("slope"), F.round("intercept", 8).alias("intercept")), "SELECT round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 8) AS intercept FROM PARTS")
_add("allequal", lambda f: ma.allequal(f, "x", "x"), "SELECT bool_and(coalesce(x = x, true)) AS allequal FROM PARTS")
_add("allclose", lambda f: ma.allclose(f.withColumn("z", F.col("x") * 1.000001), "x", "z"), "SELECT bool_and(coalesce(abs(x - x * 1.000001) <= 1e-8 + 1e-5 * abs(x * 1.000001), true)) AS allclose FROM PARTS")

# Order.
_IN = "(PARTITION BY p_brand ORDER BY {})"
_add("cumsum", lambda f: f.select("p_partkey", (F.round(ma.cumulative("cumsum", F.col("x"), ["p_brand"], ["p_partkey"]), 6) + 0.0).alias("z")), f"SELECT p_partkey, CASE WHEN x IS NOT NULL THEN round(sum(x) OVER {_IN.format('p_partkey ROWS UNBOUNDED PRECEDING')}, 6) + 0.0 END AS z FROM PARTS")
_add("cumprod", lambda f: f.select("p_partkey", ma.cumulative("cumprod", F.signum("x"), ["p_brand"], ["p_partkey"]).alias("z")).withColumn("z", F.col("z") + 0.0), f"SELECT p_partkey, CASE WHEN x IS NOT NULL THEN (product(sign(x)) OVER {_IN.format('p_partkey ROWS UNBOUNDED PRECEDING')})::DOUBLE + 0.0 END AS z FROM PARTS")
for _name in ("argsort", "sort"):
    _add(_name, lambda f: f.select("p_partkey", "x", ma.ranks(F.col("x"), ["p_brand"], ["p_partkey"]).alias("rank")), f"SELECT p_partkey, x, (row_number() OVER {_IN.format('x NULLS LAST, p_partkey')} - 1)::INTEGER AS rank FROM PARTS")
_add("unique", lambda f: ma.unique(f, "x"), "SELECT x, count(*) AS count FROM PARTS GROUP BY x")
_add("clump_masked", lambda f: ma.runs(f, "x", "p_partkey", True, ["p_brand"]).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("last") - F.col("first")).alias("s")), f"SELECT p_brand, count(*) AS n, sum(l - f)::BIGINT AS s FROM (SELECT p_brand, min(p_partkey) AS f, max(p_partkey) AS l FROM (SELECT *, p_partkey - row_number() OVER {_IN.format('p_partkey')} AS g FROM PARTS WHERE x IS NULL) GROUP BY p_brand, g) GROUP BY p_brand")
_add("flatnotmasked_contiguous", lambda f: ma.runs(f.select("p_brand", "p_partkey", "y"), "y", "p_partkey", False, ["p_brand"]), f"SELECT p_brand, min(p_partkey) AS first, max(p_partkey) AS last FROM (SELECT *, p_partkey - row_number() OVER {_IN.format('p_partkey')} AS g FROM PARTS WHERE y IS NOT NULL) GROUP BY p_brand, g")
_add("notmasked_contiguous", lambda f: ma.runs(f.withColumn("i", F.col("i") % 2).select("i", "p_partkey", "y"), "y", "p_partkey", False, ["i"]), "SELECT i, min(p_partkey) AS first, max(p_partkey) AS last FROM (SELECT *, p_partkey - row_number() OVER (PARTITION BY i ORDER BY p_partkey) AS g FROM (SELECT p_partkey, y, i % 2 AS i FROM PARTS) WHERE y IS NOT NULL) GROUP BY i, g")
_add("flatnotmasked_edges", lambda f: ma.edges(f, "x", "p_partkey"), "SELECT min(p_partkey) AS first, max(p_partkey) AS last FROM PARTS WHERE x IS NOT NULL")
_add("notmasked_edges", lambda f: ma.edges(f, "x", "p_partkey", ["i"]), "SELECT i, min(p_partkey) FILTER (x IS NOT NULL) AS first, max(p_partkey) FILTER (x IS NOT NULL) AS last FROM PARTS GROUP BY i")

# Matrices of brand by size: masked where a cell has no masked part.
_GRID = lambda f: f.groupBy("p_brand", "j").agg(F.when(F.count("x") % 5 != 0, F.count("x")).alias("z"))
_G = "(SELECT p_brand, j, CASE WHEN count(x) % 5 <> 0 THEN count(x) END AS z FROM PARTS GROUP BY p_brand, j)"
_ROW, _COLUMN = "bool_or(z IS NULL) OVER (PARTITION BY p_brand)", "bool_or(z IS NULL) OVER (PARTITION BY j)"
for _name, _axes, _hit in (("rows", ["p_brand"], _ROW), ("cols", ["j"], _COLUMN), ("rowcols", ["p_brand", "j"], f"({_ROW} OR {_COLUMN})")):
    _add(f"mask_{_name}", lambda f, a=_axes: ma.mask_axis(_GRID(f), "z", a), f"SELECT p_brand, j, CASE WHEN NOT {_hit} THEN z END AS z FROM {_G}")
    _add(f"compress_{_name}", lambda f, a=_axes: ma.compress_axis(_GRID(f), "z", a), f"SELECT p_brand, j, z FROM (SELECT *, {_hit} AS hit FROM {_G}) WHERE NOT hit")
_add("compress_nd", lambda f: ma.compress_axis(_GRID(f), "z", ["p_brand", "j"]), f"SELECT p_brand, j, z FROM (SELECT *, {_ROW} OR {_COLUMN} AS hit FROM {_G}) WHERE NOT hit")

# Sets.
for _name, _sql in {"intersect1d": "INTERSECT", "union1d": "UNION", "setdiff1d": "EXCEPT"}.items():
    _add(_name, lambda f, n=_name: ma.set_operation(n, f.select("x"), f.select(F.col("y").alias("x"))), f"SELECT x FROM PARTS {_sql} SELECT y AS x FROM PARTS")
_add("setxor1d", lambda f: ma.set_operation("setxor1d", f.select("x"), f.select(F.col("y").alias("x"))), "(SELECT x FROM PARTS EXCEPT SELECT y FROM PARTS) UNION (SELECT y FROM PARTS EXCEPT SELECT x FROM PARTS)")
for _name in ("in1d", "isin"):
    _add(_name, lambda f: ma.membership(f.select("p_partkey", "x"), "x", f.select("y"), "hit").drop("x"), "SELECT p_partkey, CASE WHEN x IS NOT NULL THEN x IN (SELECT y FROM PARTS WHERE y IS NOT NULL) END AS hit FROM PARTS")
