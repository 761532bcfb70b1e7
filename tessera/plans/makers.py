"""Queries of made arrays and of functions of one's own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import apply, types
from tessera.sources import text

QUERIES, ORACLES = {}, {}


def _add(name, run, sql):
    QUERIES[name] = lambda spark, sf_dir: run(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    ORACLES[name] = sql


# Sizes come from the number of suppliers, so what is made grows with the tables.
_n = lambda t: t("supplier").count()
_K = "(SELECT row_number() OVER () - 1 AS k, count(*) OVER () AS n FROM supplier)"
_PLACES = f"(SELECT k AS i0, j AS i1, l AS i2 FROM {_K} s, range(3) a(j), range(4) b(l))"
_add("fromfunction", lambda s, t: text.fromfunction(s, lambda i, j, k: i * 100 + j * 10 + k, (_n(t), 3, 4)), f"SELECT *, i0 * 100 + i1 * 10 + i2 AS x FROM {_PLACES}")
_add("ndindex", lambda s, t: text.empty(s, (_n(t), 3, 4)).drop("x"), f"SELECT * FROM {_PLACES}")
for _name, _value in (("zeros", "0e0"), ("ones", "1e0"), ("empty", "NULL::DOUBLE")):
    _add(_name, lambda s, t, n=_name: getattr(text, n)(s, (_n(t), 3, 4)), f"SELECT *, {_value} AS x FROM {_PLACES}")
for _name in ("mgrid", "ogrid"):
    _add(_name, lambda s, t: text.mgrid(s, [(0.0, _n(t) * 0.5, 0.5), (-1.0, 2.0, 1.0)]), f"SELECT k AS i0, j AS i1, k * 0.5::DOUBLE AS x0, (j - 1)::DOUBLE AS x1 FROM {_K} s, range(3) b(j)")
_add("arange", lambda s, t: text.arange(s, 2.0, 2.0 + _n(t) * 0.75, 0.75), f"SELECT k AS pos, 2 + k * 0.75::DOUBLE AS x FROM {_K} s")
_add("linspace", lambda s, t: text.linspace(s, -1.0, 3.0, _n(t)).withColumn("x", F.round("x", 9) + 0.0), f"SELECT k AS pos, round(-1 + k * 4e0 / (n - 1), 9) + 0.0 AS x FROM {_K} s")
_add("linspace_open", lambda s, t: text.linspace(s, 5.0, -3.0, _n(t), endpoint=False).withColumn("x", F.round("x", 9) + 0.0), f"SELECT k AS pos, round(5 - k * 8e0 / n, 9) + 0.0 AS x FROM {_K} s")
_add("logspace", lambda s, t: text.logspace(s, 0.0, 4.0, _n(t), 2.0).withColumn("x", F.round("x", 9)), f"SELECT k AS pos, round(pow(2, k * 4e0 / (n - 1)), 9) AS x FROM {_K} s")
for _name in ("eye", "identity"):
    _add(_name, lambda s, t, n=_name: text.eye(s, _n(t), 2 * (n == "eye")), f"SELECT k AS i, k + {2 * (_name == 'eye')} AS j, 1e0 AS x FROM {_K} s WHERE k + {2 * (_name == 'eye')} < n")
_add("full", lambda s, t: text.full(s, (_n(t), 4), 2.5), f"SELECT k AS i, j, 2.5e0 AS x FROM {_K} s, range(4) b(j)")
_matrix = lambda t: t("lineitem").groupBy((F.col("l_suppkey") % 4).alias("i"), (F.col("l_partkey") % 6).alias("j")).agg(F.sum("l_quantity").cast("double").alias("x"))
_M = "(SELECT l_suppkey % 4 AS i, l_partkey % 6 AS j, sum(l_quantity)::DOUBLE AS x FROM lineitem GROUP BY ALL)"
_add("ix_", lambda s, t: text.ix_(_matrix(t), ["i", "j"], [s.createDataFrame([(1,), (3,)], "p long"), s.createDataFrame([(0,), (2,), (5,)], "p long")]), f"SELECT (i - 1) // 2 AS i, CASE j WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS j, x FROM {_M} WHERE i IN (1, 3) AND j IN (0, 2, 5)")

_add("vectorize", lambda s, t: t("part").select("p_partkey", apply.vectorize(lambda a, b: a if a > b else a + b, "bigint")(F.col("p_size"), F.col("p_partkey") % 50).alias("y")), "SELECT p_partkey, CASE WHEN p_size > p_partkey % 50 THEN p_size ELSE p_size + p_partkey % 50 END::BIGINT AS y FROM part")
_add("frompyfunc", lambda s, t: t("part").select("p_partkey", apply.frompyfunc(lambda a, b: f"{a}:{b}", 2)(F.col("p_brand"), F.col("p_size")).alias("y")), "SELECT p_partkey, p_brand || ':' || p_size AS y FROM part")
_add("apply_along_axis", lambda s, t: apply.apply_along_axis(_matrix(t), lambda v: v - np.roll(v, 1), ["i"], "j", "x").withColumn("y", F.round("y", 4)), f"SELECT i, j, round(x - coalesce(lag(x) OVER (PARTITION BY i ORDER BY j), last_value(x) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 4) AS y FROM {_M}")
_add("apply_along_axis_to_number", lambda s, t: apply.apply_along_axis(_matrix(t), np.ptp, ["i"], "j", "x"), f"SELECT i, 0::BIGINT AS j, max(x) - min(x) AS y FROM {_M} GROUP BY i")
_add("apply_over_axes", lambda s, t: apply.apply_over_axes(_matrix(t), F.sum, ["i", "j"], ["j", "i"], "x"), f"SELECT 0::BIGINT AS i, 0::BIGINT AS j, sum(x) AS x FROM {_M}")
_add("dtype_of", lambda s, t: s.createDataFrame([(c, types.dtype_of(t("nation"), c)) for c in t("nation").columns], "name string, dtype string"),
     "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' ELSE 'str' END AS dtype FROM (DESCRIBE nation)")
