"""Queries of polynomial series over parts; the SQL states every polynomial by its powers of x."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.series import BASES

QUERIES, ORACLES = {}, {}

#: The first polynomials of each basis by coefficients of powers, lowest first (fixed values).
POWERS = {
    "poly": [[1], [0, 1], [0, 0, 1], [0, 0, 0, 1], [0, 0, 0, 0, 1]],
    "cheb": [[1], [0, 1], [-1, 0, 2], [0, -3, 0, 4], [1, 0, -8, 0, 8]],
    "leg": [[1], [0, 1], [-0.5, 0, 1.5], [0, -1.5, 0, 2.5], [0.375, 0, -3.75, 0, 4.375]],
    "herm": [[1], [0, 2], [-2, 0, 4], [0, -12, 0, 8], [12, 0, -48, 0, 16]],
    "herme": [[1], [0, 1], [-1, 0, 1], [0, -3, 0, 1], [3, 0, -6, 0, 1]],
    "lag": [[1], [1, -1], [1, -2, 0.5], [1, -3, 1.5, -1 / 6], [1, -4, 3, -2 / 3, 1 / 24]],
}
_C = ("(p_size % 5 - 2)::DOUBLE", "(p_partkey % 7 - 3)::DOUBLE", "(p_size % 3 - 1)::DOUBLE", "(p_partkey % 4 - 1)::DOUBLE")
_X, _Y, _Z = "((p_size - 25) / 20e0)", "((p_partkey % 13 - 6) / 8e0)", "((p_partkey % 5 - 2) / 3e0)"
#: Results are decimal fractions, many of them halfway between two; this keeps them off ties.
OFF_TIES = 0.7071067811865476
_GRID = [[1.0, -2.0], [0.5, 3.0]]
_CUBE = [_GRID, [[2.0, 0.0], [-1.0, 1.0]]]


def _power_sql(coefficients, x):
    return "(" + " + ".join(f"({c!r}::DOUBLE) * pow({x}, {k})" for k, c in enumerate(coefficients)) + ")"


def _series_sql(basis, c, x, change=lambda p: p):
    return "(" + " + ".join(f"({w}) * {_power_sql(change(POWERS[basis][k]), x)}" for k, w in enumerate(c)) + ")"


def _slope(p):
    return [k * c for k, c in enumerate(p)][1:] or [0]


def _area(p):
    return [0, *[c / (k + 1) for k, c in enumerate(p)]]


def _frame(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = [F.col("p_size") % 5 - 2, F.col("p_partkey") % 7 - 3, F.col("p_size") % 3 - 1, F.col("p_partkey") % 4 - 1]
    return part.select(
        "p_partkey", F.array(*[k.cast("double") for k in c]).alias("c"), ((F.col("p_size") - 25) / 20.0).alias("x"), ((F.col("p_partkey") % 13 - 6) / 8.0).alias("y"), ((F.col("p_partkey") % 5 - 2) / 3.0).alias("z")
    )


def _add(name, make, sql):
    QUERIES[name] = lambda spark, sf_dir: _frame(spark, sf_dir).select("p_partkey", (F.round(make() * OFF_TIES, 5) + 0.0).alias("v"))
    ORACLES[name] = f"SELECT p_partkey, round(({sql})::DOUBLE * {OFF_TIES}::DOUBLE, 5) + 0.0 AS v FROM part"


_col = F.col

for _name, _b in BASES.items():
    _p = POWERS[_name]
    _s = _series_sql(_name, _C, _X)
    _one = [1.0, -2.0, 0.5]
    _a = _series_sql(_name, [str(v) for v in _one], _X)
    _add(f"{_name}val_series", lambda b=_b: b.val(_col("x"), _col("c"), 4), _s)
    _add(f"{_name}mulx", lambda b=_b: b.val(_col("x"), b.mulx(_col("c")), 5), f"{_X} * {_s}")
    _add(f"{_name}add", lambda b=_b: b.val(_col("x"), b.add(_col("c"), F.array(*[F.lit(v) for v in (1.0, -2.0, 0.5)])), 4), f"{_s} + {_a}")
    _add(f"{_name}sub", lambda b=_b: b.val(_col("x"), b.sub(F.array(*[F.lit(v) for v in (1.0, -2.0, 0.5)]), _col("c")), 4), f"{_a} - {_s}")
    _add(f"{_name}mul", lambda b=_b: b.val(_col("x"), b.mul([1.0, -2.0, 0.5], _col("c")), 6), f"{_s} * {_a}")
    _add(f"{_name}pow", lambda b=_b: b.val(_col("x"), b.pow([1.0, -2.0, 0.5], 3), 7), f"pow({_a}, 3)")
    _add(f"{_name}fromroots", lambda b=_b: b.val(_col("x"), b.fromroots([_col("y"), _col("z"), F.lit(0.5)]), 4), f"({_X} - {_Y}) * ({_X} - {_Z}) * ({_X} - 0.5)")
    _add(f"{_name}line", lambda b=_b: b.val(_col("x"), b.line(_col("y"), _col("z")), 2), f"{_Y} + {_Z} * {_X}")
    _add(f"{_name}der", lambda b=_b: b.val(_col("x"), b.der(_col("c")), 3), _series_sql(_name, _C, _X, _slope))
    _add(f"{_name}int", lambda b=_b: b.val(_col("x"), b.int(_col("c"), 4), 5), _series_sql(_name, _C, _X, _area))
    _add(f"{_name}trim", lambda b=_b: F.size(b.trim(_col("c"), 1.0)).cast("double"), f"CASE WHEN abs({_C[3]}) > 1 THEN 4 WHEN abs({_C[2]}) > 1 THEN 3 WHEN abs({_C[1]}) > 1 THEN 2 ELSE 1 END")
    _add(f"{_name}vander", lambda b=_b: F.aggregate(b.vander(_col("x"), 4), F.lit(0.0), lambda acc, v: acc * 3 + v), " + ".join(f"{3 ** (4 - k)} * {_power_sql(p, _X)}" for k, p in enumerate(_p)))
    _add(f"{_name}vander2d", lambda b=_b: F.aggregate(b.vander2d(_col("x"), _col("y"), (2, 1)), F.lit(0.0), lambda acc, v: acc * 3 + v), " + ".join(f"{3 ** (5 - 2 * i - j)} * {_power_sql(_p[i], _X)} * {_power_sql(_p[j], _Y)}" for i in range(3) for j in range(2)))
    _add(f"{_name}vander3d", lambda b=_b: F.aggregate(b.vander3d(_col("x"), _col("y"), _col("z"), (1, 1, 1)), F.lit(0.0), lambda acc, v: acc * 3 + v), " + ".join(f"{3 ** (7 - 4 * i - 2 * j - k)} * {_power_sql(_p[i], _X)} * {_power_sql(_p[j], _Y)} * {_power_sql(_p[k], _Z)}" for i in range(2) for j in range(2) for k in range(2)))
    _add(f"{_name}val2d", lambda b=_b: b.val2d(_col("x"), _col("y"), _GRID), " + ".join(f"({_GRID[i][j]}) * {_power_sql(_p[i], _X)} * {_power_sql(_p[j], _Y)}" for i in range(2) for j in range(2)))
    _add(f"{_name}val3d", lambda b=_b: b.val3d(_col("x"), _col("y"), _col("z"), _CUBE), " + ".join(f"({_CUBE[i][j][k]}) * {_power_sql(_p[i], _X)} * {_power_sql(_p[j], _Y)} * {_power_sql(_p[k], _Z)}" for i in range(2) for j in range(2) for k in range(2)))
_WEIGHTS = {"poly": "1", "cheb": f"1 / (sqrt(1 + {_Y}) * sqrt(1 - {_Y}))", "leg": "1", "herm": f"exp(-{_Y} * {_Y})", "herme": f"exp(-{_Y} * {_Y} / 2)", "lag": f"exp(-{_Y})"}
for _name, _sql in _WEIGHTS.items():
    _add(f"{_name}weight", lambda b=BASES[_name]: b.weight(_col("y")), _sql)

# Changes of basis, division by a series of degree 2, fits and roots.
_BY = [1.0, -2.0, 0.5]
for _name, _b in BASES.items():
    _s = _series_sql(_name, _C, _X)
    if _name != "poly":
        _add(f"{_name}2poly", lambda b=_b: BASES["poly"].val(_col("x"), b.convert(_col("c"), BASES["poly"]), 4), _s)
        _add(f"poly2{_name}", lambda b=_b: b.val(_col("x"), BASES["poly"].convert(_col("c"), b), 4), _series_sql("poly", _C, _X))
    _n = ["(" + " + ".join(f"{w} * ({POWERS[_name][k][j]!r}::DOUBLE)" for k, w in enumerate(_C) if j < len(POWERS[_name][k])) + ")" for j in range(4)]
    _d = [sum(v * POWERS[_name][k][j] for k, v in enumerate(_BY) if j < len(POWERS[_name][k])) for j in range(3)]
    _q1 = f"({_n[3]} / {_d[2]!r}::DOUBLE)"
    _q0 = f"(({_n[2]} - {_q1} * {_d[1]!r}::DOUBLE) / {_d[2]!r}::DOUBLE)"
    _r1, _r0 = f"({_n[1]} - {_q1} * {_d[0]!r}::DOUBLE - {_q0} * {_d[1]!r}::DOUBLE)", f"({_n[0]} - {_q0} * {_d[0]!r}::DOUBLE)"
    _add(f"{_name}div", lambda b=_b: b.val(_col("x"), b.divmod(_col("c"), _BY)[0], 2) + 3 * b.val(_col("x"), b.divmod(_col("c"), _BY)[1], 2), f"{_q0} + {_q1} * {_X} + 3 * ({_r0} + {_r1} * {_X})")
    _add(f"{_name}one_x_zero", lambda b=_b: 5 * b.val(_col("x"), b.x, 2) + b.val(_col("x"), b.one, 2) + b.val(_col("x"), b.zero, 2), f"5 * {_X} + 1")
    _add(f"{_name}domain", lambda b=_b: b.mapparms((-4.0, 12.0))[0] + b.mapparms((-4.0, 12.0))[1] * _col("x"), f"({_X} + 4) / 16 * {_b.domain[1] - _b.domain[0]} + {_b.domain[0]}")
    QUERIES[f"{_name}roots"] = lambda spark, sf_dir, b=_b: b.roots(_frame(spark, sf_dir).select("p_partkey", b.fromroots([_col("y"), _col("y") + 1, _col("y") + 2.5]).alias("c")), "c").select("p_partkey", F.posexplode(F.array_sort(F.transform("y", lambda r: F.round(r["re"] * OFF_TIES, 5) + 0.0))).alias("j", "v"))
    ORACLES[f"{_name}roots"] = f"SELECT p_partkey, k::INTEGER AS j, round(({_Y} + [0, 1, 2.5][k + 1]) * {OFF_TIES}::DOUBLE, 5) + 0.0 AS v FROM part, range(3) r(k)"
    # A fit of degree 3 to a series of degree 3 gives its coefficients back.
    QUERIES[f"{_name}fit"] = lambda spark, sf_dir, b=_b: spark.createDataFrame([(k, round(v, 4) + 0.0) for k, v in enumerate(b.fit(_frame(spark, sf_dir).select("x", b.val(_col("x"), F.array(*[F.lit(v) for v in (1.5, -2.0, 0.5, 0.25)]), 4).alias("v")), "x", "v", 3))], "k int, v double")
    ORACLES[f"{_name}fit"] = "SELECT k::INTEGER AS k, [1.5, -2.0, 0.5, 0.25][k + 1]::DOUBLE AS v FROM range(4) r(k)"
