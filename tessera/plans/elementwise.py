"""One query for each elementwise function, over columns of ``part`` that lie in the function's domain."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions.ufuncs import INTEGER_ONLY, UFUNCS

#: Quotients that round up to whole numbers, infinities, NaN and zeros of both signs beside ordinary prices.
EDGES = (
    "CASE p_partkey % 9 WHEN 0 THEN 1.0 WHEN 1 THEN 6.0 WHEN 2 THEN -5.0 WHEN 3 THEN p_size / 10.0 WHEN 4 THEN 5.0 WHEN 5 THEN CAST(CASE p_partkey % 4 WHEN 0 THEN 'Infinity' WHEN 1 THEN 'NaN' WHEN 2 THEN '-0.0' ELSE '0.0' END AS DOUBLE) ELSE p_retailprice - 1500 END",
    "CASE p_partkey % 7 WHEN 0 THEN 0.1 WHEN 1 THEN -0.1 WHEN 2 THEN CAST(CASE p_partkey % 6 WHEN 0 THEN 'Infinity' WHEN 1 THEN '-Infinity' WHEN 2 THEN '0.0' WHEN 3 THEN '-0.0' WHEN 4 THEN 'NaN' ELSE '0.3' END AS DOUBLE) WHEN 3 THEN p_size / 10.0 ELSE p_size - 25.5 END",
)
SIGNED = ("(p_retailprice - 1500) / 500.0", "p_size / 10.0 - 2.45")
#: name -> SQL of the operands, where the usual ones are outside the domain or have ties that libraries round apart.
OPERANDS = {
    **dict.fromkeys(("sqrt", "log", "log2", "log10", "log1p", "frexp_mantissa", "frexp_exponent", "reciprocal"), ("p_retailprice / 7.3e0", "1.0")),
    **dict.fromkeys(("arcsin", "arccos", "arctanh"), ("(p_size - 25) / 26e0", "1.0")),
    "arccosh": ("p_size + 1.0", "1.0"),
    **dict.fromkeys(("power", "float_power"), ("p_retailprice / 900.0", "p_size / 10.0")),
    "ldexp": ("p_retailprice / 1000.0", "p_size - 20"),
    **dict.fromkeys(("equal", "not_equal", "less", "less_equal", "greater", "greater_equal", "logical_and", "logical_or", "logical_xor", "logical_not"), ("p_size % 7 - 3", "p_partkey % 5 - 2")),
    **dict.fromkeys(("left_shift", "right_shift"), ("p_partkey", "p_size % 20")),
    **dict.fromkeys(("floor_divide", "mod"), EDGES),
    **dict.fromkeys(("floor_divide_integer", "mod_integer"), ("p_partkey * (p_size % 3 - 1)", "p_size % 7 - 3")),
    "invert": ("p_partkey", "1"),
}


def _doubles(expression: str) -> str:
    """Literals such as 2.45 as doubles, which the SQL takes them for beside a quotient; Spark would subtract exact decimals."""
    return re.sub(r"'[^']*'|\b\d+\.\d+\b", lambda found: found[0] if found[0][0] == "'" else f"{found[0]}D", expression)


def _query(name: str):
    ufunc = UFUNCS[name]
    x, y = OPERANDS.get(name, ("p_partkey", "p_size") if name in INTEGER_ONLY else SIGNED)

    def run(spark, sf_dir):
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        kind = "bigint" if name in INTEGER_ONLY or "%" in x and x != EDGES[0] else "double"
        args = [F.expr(f"cast({_doubles(e)} as {kind if name != 'ldexp' or e == x else 'int'})") for e in (x, y)[: ufunc.arity]]
        value = ufunc(*args)
        frame = part.select("p_partkey", value.alias("y"))
        return frame.withColumn("y", F.round("y", 6) + 0.0) if dict(frame.dtypes)["y"] == "double" else frame

    kind = "BIGINT" if name in INTEGER_ONLY or "%" in x and x != EDGES[0] else "DOUBLE"
    sql = ufunc.sql.format(x=f"({x})::{kind}" if kind == "DOUBLE" else f"({x})::BIGINT", y=f"({y})::{kind}")
    sql = f"SELECT p_partkey, v AS y FROM (SELECT p_partkey, {sql} AS v FROM part)"
    return run, sql


_ROUND = "SELECT p_partkey, round(y, 6) + 0.0 AS y FROM ({}) t"
_PLAIN = {
    "isnan", "isinf", "isfinite", "signbit", "logical_not", "frexp_exponent", "equal", "not_equal", "less", "less_equal", "greater", "greater_equal", "logical_and", "logical_or", "logical_xor",
} | INTEGER_ONLY

QUERIES, ORACLES = {}, {}
for _name in UFUNCS:
    _run, _sql = _query(_name)
    QUERIES[f"ufunc_{_name}"] = _run
    ORACLES[f"ufunc_{_name}"] = _sql if _name in _PLAIN else _ROUND.format(_sql)
