"""Queries of axes, joins, splits, places, comparisons and small matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.ufuncs import FLOOR_SQL, MOD_SQL
from tessera.operators import axes, tensor
from tessera.operators.scans import scan
from tessera.operators.window import ordered
from tessera.plans import elementwise

QUERIES, ORACLES = {}, {}


def _add(name, table, run, sql):
    QUERIES[name] = lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    ORACLES[name] = sql


# A tensor of 4 x 6 x 3 cells out of all line items.
_SHAPE = (4, 6, 3)
_G = "(SELECT l_suppkey % 4 AS i, l_partkey % 6 AS j, (l_linenumber % 3)::BIGINT AS k, sum(l_quantity) AS x FROM lineitem GROUP BY ALL)"
_M = "(SELECT l_suppkey % 4 AS i, l_partkey % 6 AS j, sum(l_quantity) AS x FROM lineitem GROUP BY ALL)"
_IJK = ["i", "j", "k"]


def _grid(f):
    return f.groupBy((F.col("l_suppkey") % 4).alias("i"), (F.col("l_partkey") % 6).alias("j"), (F.col("l_linenumber") % 3).cast("bigint").alias("k")).agg(F.sum("l_quantity").alias("x"))


def _matrix(f):
    return f.groupBy((F.col("l_suppkey") % 4).alias("i"), (F.col("l_partkey") % 6).alias("j")).agg(F.sum("l_quantity").alias("x"))


_add("permute_dims", "lineitem", lambda f: axes.permute_dims(_grid(f), _IJK, [2, 0, 1]), f"SELECT k AS i, i AS j, j AS k, x FROM {_G}")
_add("swapaxes", "lineitem", lambda f: axes.swapaxes(_grid(f), _IJK, 0, 2), f"SELECT k AS i, j, i AS k, x FROM {_G}")
_add("moveaxis", "lineitem", lambda f: axes.moveaxis(_grid(f), _IJK, 0, 2), f"SELECT j AS i, k AS j, i AS k, x FROM {_G}")
_add("rollaxis", "lineitem", lambda f: axes.rollaxis(_grid(f), _IJK, 2), f"SELECT k AS i, i AS j, j AS k, x FROM {_G}")
_add("matrix_transpose", "lineitem", lambda f: axes.matrix_transpose(_matrix(f)), f"SELECT j AS i, i AS j, x FROM {_M}")
for _name in ("expand_dims", "newaxis", "atleast_2d", "atleast_3d"):
    _add(_name, "lineitem", lambda f: axes.expand_dims(_matrix(f), "k"), f"SELECT *, 0::BIGINT AS k FROM {_M}")
_add("squeeze", "lineitem", lambda f: axes.squeeze(axes.expand_dims(_matrix(f), "k"), "k"), f"SELECT * FROM {_M}")
_add("ravel", "lineitem", lambda f: axes.ravel(_grid(f), _IJK, _SHAPE), f"SELECT (i * 6 + j) * 3 + k AS pos, x FROM {_G}")
_add("ravel_multi_index", "part", lambda f: f.select("p_partkey", axes.ravel_multi_index([F.col("p_size") % 5, F.col("p_partkey") % 7], (5, 7)).alias("at")), "SELECT p_partkey, (p_size % 5) * 7 + p_partkey % 7 AS at FROM part")
_add("unravel_index", "part", lambda f: f.select("p_partkey", *[c.alias(n) for c, n in zip(axes.unravel_index(F.col("p_partkey") % 105, (3, 5, 7)), "abc")]), "SELECT p_partkey, p_partkey % 105 // 35 AS a, p_partkey % 35 // 7 AS b, p_partkey % 7 AS c FROM part")
_add("ndenumerate", "lineitem", lambda f: _grid(f).select(axes.ravel_multi_index([F.col(c) for c in _IJK], _SHAPE).alias("at"), *_IJK, "x"), f"SELECT (i * 6 + j) * 3 + k AS at, i, j, k, x FROM {_G}")
_VECTOR = lambda f: f.select(F.col("n_nationkey").cast("bigint").alias("i"), F.col("n_name").alias("x"))
_V = "(SELECT n_nationkey::BIGINT AS i, n_name AS x FROM nation)"
_add("resize", "nation", lambda f: axes.resize(_VECTOR(f), "i", 25, 60), f"SELECT i + c * 25 AS i, x FROM {_V}, (SELECT unnest([0, 1, 2]) AS c) WHERE i + c * 25 < 60")
_add("fliplr", "lineitem", lambda f: axes.flip(_matrix(f), "j", 6), f"SELECT i, 5 - j AS j, x FROM {_M}")
_add("flipud", "lineitem", lambda f: axes.flip(_matrix(f), "i", 4), f"SELECT 3 - i AS i, j, x FROM {_M}")

_add("stack", "lineitem", lambda f: axes.stack([_matrix(f), _matrix(f)], "k"), f"SELECT *, 0::BIGINT AS k FROM {_M} UNION ALL SELECT *, 1 FROM {_M}")
for _name, _axis, _size in (("hstack", "j", 6), ("vstack", "i", 4), ("row_stack", "i", 4)):
    _add(_name, "lineitem", lambda f, a=_axis, s=_size: axes.concatenate([_matrix(f), _matrix(f)], a, [s, s]), f"SELECT i, j, x FROM {_M} UNION ALL SELECT i + {4 * (_axis == 'i')}, j + {6 * (_axis == 'j')}, x FROM {_M}")
_add("dstack", "lineitem", lambda f: axes.concatenate([_grid(f), _grid(f)], "k", [3, 3]), f"SELECT i, j, k, x FROM {_G} UNION ALL SELECT i, j, k + 3, x FROM {_G}")
_add("append", "nation", lambda f: axes.concatenate([_VECTOR(f), _VECTOR(f)], "i", [25, 25]), f"SELECT i, x FROM {_V} UNION ALL SELECT i + 25, x FROM {_V}")
for _name in ("r_", "c_"):
    _add(_name, "nation", lambda f, n=_name: axes.concatenate([_VECTOR(f), _VECTOR(f)], "i", [25, 25]) if n == "r_" else axes.column_stack([_VECTOR(f), _VECTOR(f)]), f"SELECT i, x FROM {_V} UNION ALL SELECT i + 25, x FROM {_V}" if _name == "r_" else f"SELECT *, 0::BIGINT AS j FROM {_V} UNION ALL SELECT *, 1 FROM {_V}")
_add("column_stack", "nation", lambda f: axes.column_stack([_VECTOR(f), _VECTOR(f)]), f"SELECT *, 0::BIGINT AS j FROM {_V} UNION ALL SELECT *, 1 FROM {_V}")
_add("block", "lineitem", lambda f: axes.block([[_matrix(f), _matrix(f)], [_matrix(f), _matrix(f)]], [4, 4], [6, 6]), f"SELECT i + a * 4 AS i, j + b * 6 AS j, x FROM {_M}, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)")
_add("unstack", "lineitem", lambda f: axes.unstack(_grid(f), "k", 3)[1], f"SELECT i, j, x FROM {_G} WHERE k = 1")
for _name, _axis, _size, _parts in (("split", "i", 4, 2), ("vsplit", "i", 4, 4), ("hsplit", "j", 6, 3), ("dsplit", "k", 3, 3)):
    _add(_name, "lineitem", lambda f, a=_axis, s=_size, p=_parts: axes.split(_grid(f), a, s, p), f"SELECT i{' % ' + str(4 // _parts) if _axis == 'i' else ''} AS i, j{' % 2' if _axis == 'j' else ''} AS j, k{' % 1' if _axis == 'k' else ''} AS k, x, {_axis} // {_size // _parts} AS part FROM {_G}")

_add("take_along_axis", "lineitem", lambda f: axes.take_along_axis(_matrix(f), _matrix(f).select("i", (F.col("j") * 5 % 6).alias("at"), F.col("j").alias("n")), "j", ["i"], "at"), f"SELECT a.i, a.j * 5 % 6 AS at, a.j AS n, b.x FROM {_M} a JOIN {_M} b ON b.i = a.i AND b.j = a.j * 5 % 6")
_add("put_along_axis", "lineitem", lambda f: axes.put_along_axis(_matrix(f), _matrix(f).filter("j % 2 = 0").select("i", "j", F.lit(-1.0).alias("new")), "j", ["i"], "x", "new"), f"SELECT i, j, CASE WHEN j % 2 = 0 THEN -1.0 ELSE x END::DOUBLE AS x FROM {_M}")
for _name in ("putmask_plain", "copyto", "place"):
    _add(_name, "part", lambda f: f.select("p_partkey", axes.put_where(F.col("p_size"), F.col("p_size") > 30, F.lit(0)).alias("x")), "SELECT p_partkey, CASE WHEN p_size > 30 THEN 0 ELSE p_size END AS x FROM part")
_add("fill_diagonal", "lineitem", lambda f: axes.fill_diagonal(_matrix(f), 7.0), f"SELECT i, j, CASE WHEN i = j THEN 7.0 ELSE x END::DOUBLE AS x FROM {_M}")
_add("piecewise", "part", lambda f: f.select("p_partkey", axes.piecewise(F.col("p_size"), [(F.col("p_size") > 10, F.col("p_size") * 2), (F.col("p_size") > 30, -F.col("p_size"))], F.lit(0)).alias("y")), "SELECT p_partkey, CASE WHEN p_size > 30 THEN -p_size WHEN p_size > 10 THEN p_size * 2 ELSE 0 END AS y FROM part")
_add("argwhere", "lineitem", lambda f: axes.argwhere(_matrix(f), F.col("x") > 200, ["i", "j"]), f"SELECT i, j FROM {_M} WHERE x > 200")
_add("argpartition", "part", lambda f: f.select("p_partkey", axes.argpartition(F.col("p_retailprice"), 10, ["p_brand"], ["p_partkey"]).alias("side")), "SELECT p_partkey, sign(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 11)::INTEGER AS side FROM part")

_NEAR = "p_size + 1e-4 * (p_partkey % 3)"
_near = lambda: F.col("p_size") + 1e-4 * (F.col("p_partkey") % 3)
_add("isclose", "part", lambda f: f.select("p_partkey", axes.isclose(F.col("p_size"), _near()).alias("near")), f"SELECT p_partkey, abs(p_size - ({_NEAR})) <= 1e-8 + 1e-5 * abs({_NEAR}) AS near FROM part")
_add("allclose", "part", lambda f: axes.allclose(f.withColumn("other", _near()), "p_size", "other", rtol=1e-3), f"SELECT bool_and(abs(p_size - ({_NEAR})) <= 1e-8 + 1e-3 * abs({_NEAR})) AS allclose FROM part")
for _name in ("array_equal", "array_equiv"):
    _add(_name, "lineitem", lambda f: axes.array_equal(_matrix(f), axes.matrix_transpose(axes.matrix_transpose(_matrix(f))), ["i", "j"]), "SELECT true AS array_equal")
_SIGNED = "CASE p_size % 3 WHEN 0 THEN 'infinity'::DOUBLE WHEN 1 THEN '-infinity'::DOUBLE ELSE p_size END"
_signed = lambda: F.when(F.col("p_size") % 3 == 0, float("inf")).when(F.col("p_size") % 3 == 1, float("-inf")).otherwise(F.col("p_size").cast("double"))
_add("isposinf", "part", lambda f: f.select("p_partkey", axes.isposinf(_signed()).alias("y")), "SELECT p_partkey, p_size % 3 = 0 AS y FROM part")
_add("isneginf", "part", lambda f: f.select("p_partkey", axes.isneginf(_signed()).alias("y")), "SELECT p_partkey, p_size % 3 = 1 AS y FROM part")
_complex = lambda: F.struct(F.col("p_size").cast("double").alias("re"), (F.col("p_size") % 4).cast("double").alias("im"))
_add("iscomplex", "part", lambda f: f.select("p_partkey", axes.iscomplex(_complex()).alias("y")), "SELECT p_partkey, p_size % 4 <> 0 AS y FROM part")
_add("isreal", "part", lambda f: f.select("p_partkey", axes.isreal(_complex()).alias("y")), "SELECT p_partkey, p_size % 4 = 0 AS y FROM part")

_HALF = "(p_size - 25) / 2e0"
_half = lambda: (F.col("p_size") - 25) / 2.0
_add("fix", "part", lambda f: f.select("p_partkey", (axes.fix(_half()) + 0.0).alias("y")), f"SELECT p_partkey, trunc({_HALF}) + 0.0 AS y FROM part")
for _name in ("round", "around"):
    _add(_name, "part", lambda f: f.select("p_partkey", (axes.round_half_even(_half()) + 0.0).alias("y")), f"SELECT p_partkey, round_even({_HALF}, 0) + 0.0 AS y FROM part")
_EDGES = elementwise.EDGES
_add("divmod", "part", lambda f: f.select("p_partkey", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(axes.divmod_(*[F.expr(f"cast({e} as double)") for e in _EDGES]), "qr")]),
     f"SELECT p_partkey, round({FLOOR_SQL.format(x='x', y='y')}, 6) + 0.0 AS q, round({MOD_SQL.format(x='x', y='y')}, 6) + 0.0 AS r FROM (SELECT p_partkey, ({_EDGES[0]})::DOUBLE AS x, ({_EDGES[1]})::DOUBLE AS y FROM part)")
_add("logn", "part", lambda f: f.select("p_partkey", F.round(axes.logn(3, F.col("p_size")), 8).alias("y")), "SELECT p_partkey, round(ln(p_size) / ln(3), 8) AS y FROM part")
# Arguments from -700 to 672; the statement sums the power series by logarithms.
_add("i0", "part", lambda f: f.select("p_partkey", F.round(F.log(axes.i0((F.col("p_size") - 26) * 28.0)), 8).alias("y")),
     "SELECT p_partkey, CASE WHEN z = 0 THEN 0 ELSE round(2 * k * ln(z / 2) - 2 * lgamma(k + 1) + ln(list_sum([exp(2 * (j - k) * ln(z / 2) - 2 * lgamma(j + 1) + 2 * lgamma(k + 1)) FOR j IN range(800)])), 8) END AS y "
     "FROM (SELECT p_partkey, abs(p_size - 26) * 28e0 AS z, floor(abs(p_size - 26) * 14) AS k FROM part)")  # fmt: skip

# Sizes come from the number of suppliers.
_K = "(SELECT row_number() OVER () - 1 AS k, count(*) OVER () AS n FROM supplier)"
_K2 = f"(SELECT a.k AS i, b.k AS j FROM {_K} a, {_K} b)"
_add("indices", "supplier", lambda f: axes.indices(f.sparkSession, (f.count(), 7)), f"SELECT k AS i, r.range AS j FROM {_K} s, range(7) r")
for _name, _lower, _test in (("tril_indices", True, "j - i <= 1"), ("triu_indices", False, "j - i >= 1")):
    _add(_name, "supplier", lambda f, lo=_lower: axes.triangle_indices(f.sparkSession, f.count(), 1, lo), f"SELECT i, j FROM {_K2} WHERE {_test}")
    _add(f"{_name}_from", "lineitem", lambda f, lo=_lower: tensor.triangle(_matrix(f), k=1, lower=lo).select("i", "j"), f"SELECT i, j FROM {_M} WHERE {_test}")
_add("mask_indices", "supplier", lambda f: axes.indices(f.sparkSession, (f.count(), f.count())).filter("(i * j) % 3 = 1"), f"SELECT i, j FROM {_K2} WHERE (i * j) % 3 = 1")
_add("diag_indices", "supplier", lambda f: axes.diag_indices(f.sparkSession, f.count()), f"SELECT k AS i, k AS j FROM {_K} s")
_add("diag_indices_from", "lineitem", lambda f: _matrix(f).filter("i = j").select("i", "j"), f"SELECT i, j FROM {_M} WHERE i = j")
_add("tri", "supplier", lambda f: axes.tri(f.sparkSession, f.count(), 5, 1), f"SELECT k AS i, r.range AS j, (r.range - k <= 1)::INT::DOUBLE AS x FROM {_K} s, range(5) r")
_add("geomspace", "supplier", lambda f: axes.geomspace(f.sparkSession, 1.0, 1000.0, f.count()).select("pos", F.round("x", 6).alias("x")), f"SELECT k AS pos, round(pow(1000e0, k / (n - 1)::DOUBLE), 6) AS x FROM {_K} s")
_add("fftfreq", "supplier", lambda f: axes.fftfreq(f.sparkSession, f.count(), 0.5).select("pos", F.round("x", 9).alias("x")), f"SELECT k AS pos, round((CASE WHEN k < (n + 1) // 2 THEN k ELSE k - n END) / (n * 0.5e0), 9) AS x FROM {_K} s")
_add("rfftfreq", "supplier", lambda f: axes.rfftfreq(f.sparkSession, f.count(), 0.5).select("pos", F.round("x", 9).alias("x")), f"SELECT k AS pos, round(k / (n * 0.5e0), 9) AS x FROM {_K} s WHERE k <= n // 2")
_add("vander", "part", lambda f: f.select("p_partkey", F.posexplode(axes.vander(F.col("p_size") / 10.0, 5)).alias("j", "x")).select("p_partkey", "j", F.round("x", 6).alias("x")), "SELECT p_partkey, j::INTEGER AS j, round(pow(p_size / 10e0, 4 - j), 6) AS x FROM part, range(5) r(j)")
_add("vander_increasing", "part", lambda f: f.select("p_partkey", F.posexplode(axes.vander(F.col("p_size") / 10.0, 4, True)).alias("j", "x")).select("p_partkey", "j", F.round("x", 6).alias("x")), "SELECT p_partkey, j::INTEGER AS j, round(pow(p_size / 10e0, j), 6) AS x FROM part, range(4) r(j)")
_add("kaiser", "supplier", lambda f: axes.kaiser(f.sparkSession, f.count(), 6.0).select("pos", F.round("x", 8).alias("x")),
     f"SELECT k AS pos, round(list_sum([exp(2 * m * ln(greatest(z, 1e-12)) - 2 * lgamma(m + 1)) FOR m IN range(60)]) / list_sum([exp(2 * m * ln(3e0) - 2 * lgamma(m + 1)) FOR m IN range(60)]), 8) AS x FROM (SELECT k, 3e0 * sqrt(greatest(0, 1 - pow(2e0 * k / (n - 1) - 1, 2))) AS z FROM {_K} s)")
for _name, _value in (("zeros_like", 0.0), ("ones_like", 1.0), ("full_like", 2.5)):
    _add(_name, "lineitem", lambda f, v=_value: axes.full_like(_matrix(f), v), f"SELECT i, j, {_value}::DOUBLE AS x FROM {_M}")

# Matrices of two rows for each part: [[a, b], [c, d]], and the vector [e, f].
_NUMBERS = {"a": "p_size % 5 + 1", "b": "p_partkey % 3 - 1", "c": "p_size % 4 - 2", "d": "p_partkey % 7 + 2", "e": "p_size % 9", "f": "p_partkey % 5"}
_two = lambda f: f.select("p_partkey", *[F.expr(f"double({s})").alias(n) for n, s in _NUMBERS.items()]).select("p_partkey", F.array(F.array("a", "b"), F.array("c", "d")).alias("m"), F.array("e", "f").alias("v"))
_T = "(SELECT p_partkey, " + ", ".join(f"({s})::DOUBLE AS {n}" for n, s in _NUMBERS.items()) + " FROM part)"
_pair = lambda c: [(F.get(c, F.lit(k)) + 0.0).alias(f"y{k}") for k in range(2)]
_cells = lambda c: [(F.get(F.get(c, F.lit(i)), F.lit(j)) + 0.0).alias(f"y{i}{j}") for i in range(2) for j in range(2)]
_add("vecdot", "part", lambda f: _two(f).select("p_partkey", axes.vecdot(F.get("m", F.lit(0)), F.col("v")).alias("y")), f"SELECT p_partkey, a * e + b * f AS y FROM {_T}")
_add("matvec", "part", lambda f: _two(f).select("p_partkey", *_pair(axes.matvec(F.col("m"), F.col("v")))), f"SELECT p_partkey, a * e + b * f AS y0, c * e + d * f AS y1 FROM {_T}")
_add("vecmat", "part", lambda f: _two(f).select("p_partkey", *_pair(axes.vecmat(F.col("v"), F.col("m")))), f"SELECT p_partkey, e * a + f * c AS y0, e * b + f * d AS y1 FROM {_T}")
_add("matrix_power", "part", lambda f: _two(f).select("p_partkey", *_cells(axes.matrix_power(F.col("m"), 3))), f"SELECT p_partkey, p * a + q * c AS y00, p * b + q * d AS y01, r * a + s * c AS y10, r * b + s * d AS y11 FROM (SELECT *, a * a + b * c AS p, a * b + b * d AS q, c * a + d * c AS r, c * b + d * d AS s FROM {_T})")
_add("multi_dot", "part", lambda f: _two(f).select("p_partkey", *_cells(axes.matrix_product(axes.matrix_product(F.col("m"), F.col("m")), F.array(F.col("v"), F.col("v"))))), f"SELECT p_partkey, (p + q) * e + 0.0 AS y00, (p + q) * f + 0.0 AS y01, (r + s) * e + 0.0 AS y10, (r + s) * f + 0.0 AS y11 FROM (SELECT *, a * a + b * c AS p, a * b + b * d AS q, c * a + d * c AS r, c * b + d * d AS s FROM {_T})")
_add("solve", "part", lambda f: _two(f).select("p_partkey", *[(F.round(c, 8) + 0.0).alias(n) for c, n in zip([F.get(axes.solve2(F.col("m"), F.col("v")), F.lit(k)) for k in range(2)], ("y0", "y1"))]), f"SELECT p_partkey, CASE WHEN a * d <> b * c THEN round((e * d - b * f) / (a * d - b * c), 8) + 0.0 END AS y0, CASE WHEN a * d <> b * c THEN round((a * f - e * c) / (a * d - b * c), 8) + 0.0 END AS y1 FROM {_T}")
_over = lambda: ordered(["user_id"], ["ts", "event_id"])
_missing = lambda: F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
_add("nancumsum", "events", lambda f: f.select("event_id", (F.round(F.sum(F.nanvl(_missing(), F.lit(0.0))).over(_over()), 4) + 0.0).alias("y")), "SELECT event_id, round(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) + 0.0 AS y FROM events")
for _name, _largest in (("nanargmax", True), ("nanargmin", False)):
    _add(_name, "events", lambda f, up=_largest: f.withColumn("x", _missing()).filter(~F.isnan("x")).groupBy("event_type").agg((F.max_by if up else F.min_by)("event_id", F.struct("x", (-F.col("event_id") if up else F.col("event_id")).alias("t"))).alias("position")), f"SELECT event_type, {'arg_max' if _largest else 'arg_min'}(event_id, (value, {'-' if _largest else ''}event_id)) AS position FROM events WHERE event_id % 7 <> 0 GROUP BY event_type")

_three = lambda *e: F.array(*[F.expr(f"double({x})") for x in e])
_A3, _B3 = ("p_size - 20", "p_partkey % 7", "p_partkey % 11 - 5"), ("p_partkey % 5 - 2", "p_size % 9", "3")
_add("cross", "part", lambda f: f.select("p_partkey", F.posexplode(axes.cross(_three(*_A3), _three(*_B3))).alias("k", "y")).select("p_partkey", "k", (F.col("y") + 0.0).alias("y")),
     "SELECT p_partkey, k::INTEGER AS k, CASE k WHEN 0 THEN b * f - c * e WHEN 1 THEN c * d - a * f ELSE a * e - b * d END::DOUBLE + 0.0 AS y FROM (SELECT p_partkey, " + ", ".join(f"({x})::DOUBLE AS {n}" for x, n in zip(_A3 + _B3, "abcdef")) + " FROM part), range(3) r(k)")
_add("cross_of_two", "part", lambda f: f.select("p_partkey", (F.get(axes.cross(_three(*_A3[:2]), _three(*_B3[:2])), F.lit(0)) + 0.0).alias("y")), f"SELECT p_partkey, (({_A3[0]}) * ({_B3[1]}) - ({_A3[1]}) * ({_B3[0]}))::DOUBLE + 0.0 AS y FROM part")
_add("ediff1d", "events", lambda f: axes.ediff1d(f, ["ts", "event_id"], "value", [-1.0, -2.0], [99.0]).select("pos", F.round("x", 6).alias("x")),
     "SELECT pos, round(x, 6) AS x FROM (SELECT row_number() OVER w AS pos, value - lag(value) OVER w AS x FROM events WINDOW w AS (ORDER BY ts, event_id)) WHERE pos > 1 UNION ALL SELECT 0, -1 UNION ALL SELECT 1, -2 UNION ALL SELECT count(*) + 1, 99 FROM events")
_add("sort_complex", "events", lambda f: axes.sort_complex(f.select(F.struct((F.col("event_id") % 13).cast("double").alias("re"), F.round(F.col("value") - F.col("event_id") / 1e6, 7).alias("im")).alias("z")), "z").select("pos", "z.*"),
     "SELECT row_number() OVER (ORDER BY re, im) - 1 AS pos, re, im FROM (SELECT (event_id % 13)::DOUBLE AS re, round(value - event_id / 1e6, 7) AS im FROM events)")
_add("nancumprod", "events", lambda f: scan(f.select("event_id", "ts", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(1 + (F.col("event_id") % 5 - 2) / 1000.0).alias("x")), "multiply", [F.nanvl("x", F.lit(1.0))], ["ts", "event_id"]).select("event_id", F.round("y", 6).alias("y")),
     "SELECT event_id, round(exp(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE ln(1 + (event_id % 5 - 2) / 1000e0) END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), 6) AS y FROM events")
