"""Queries of order and shape over whole frames: quantiles without groups, bins, padding, correlations, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import reduce, select, sets, window

QUERIES, ORACLES = {}, {}


def _add(name, table, run, sql):
    QUERIES[name] = lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    ORACLES[name] = sql


_NAN = "CASE WHEN p_size % 7 = 0 THEN 'NaN'::DOUBLE ELSE p_retailprice END"
_nan = lambda f: f.withColumn("x", F.when(F.col("p_size") % 7 == 0, float("nan")).otherwise(F.col("p_retailprice")))
_add("quantile_of_all", "lineitem", lambda f: reduce.quantile(f, "l_extendedprice", 0.37, out="q").withColumn("q", F.round("q", 4)), "SELECT round(quantile_cont(l_extendedprice, 0.37), 4) AS q FROM lineitem")
_add("percentile", "lineitem", lambda f: reduce.percentile(f, "l_quantity", 80, ["l_returnflag"], out="q"), "SELECT l_returnflag, quantile_cont(l_quantity, 0.8)::DOUBLE AS q FROM lineitem GROUP BY ALL")
for _name, _q in (("nanquantile", 0.25), ("nanpercentile", 0.6)):
    _add(_name, "part", lambda f, q=_q: reduce.quantile(_nan(f), "x", q, ["p_brand"], out="q", nan=False).withColumn("q", F.round("q", 4)), f"SELECT p_brand, round(quantile_cont(p_retailprice, {_q}), 4) AS q FROM part WHERE p_size % 7 <> 0 GROUP BY ALL")
_add("quantile_with_nan", "part", lambda f: reduce.quantile(_nan(f), "x", 0.5, ["p_size"], out="q").select("p_size", F.isnan("q").alias("is_nan")), "SELECT p_size, bool_or(p_size % 7 = 0) AS is_nan FROM part GROUP BY ALL")

_N = "SELECT count(*)::DOUBLE AS n, max(x) - min(x) AS s, stddev_pop(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, avg(x) AS m, min(x) AS lo FROM (SELECT l_extendedprice::DOUBLE AS x FROM lineitem)"
_SKEW = "(SELECT abs(avg(pow((l_extendedprice - m) / sd, 3))) FROM lineitem, b)"
_WIDTH = {
    "sqrt": "s / sqrt(n)", "sturges": "s / (log2(n) + 1)", "rice": "s / (2 * cbrt(n))", "scott": "cbrt(24 * sqrt(pi()) / n) * sd", "fd": "2 * iqr / cbrt(n)",
    "auto": "least(2 * iqr / cbrt(n), s / (log2(n) + 1))", "doane": f"s / (1 + log2(n) + log2(1 + {_SKEW} / sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))))",
}
for _name, _width in _WIDTH.items():
    _add(f"histogram_bin_edges_{_name}", "lineitem", lambda f, n=_name: f.sparkSession.createDataFrame([(k, round(e, 4)) for k, e in enumerate(reduce.histogram_bin_edges(f, "l_extendedprice", n))], "k long, edge double"),
         f"WITH b AS ({_N}), c AS (SELECT lo, s, ceil(s / ({_width}))::BIGINT AS bins FROM b) SELECT k, round(lo + s * k / bins, 4) AS edge FROM c, range((SELECT bins + 1 FROM c)) r(k)")
_add("histogramdd", "lineitem", lambda f: reduce.histogramdd(f, ["l_quantity", "l_discount", "l_tax"], [5, 3, 2], [(0.0, 50.0), (0.0, 0.1), (0.0, 0.08)]),
     "SELECT least(floor(l_quantity::DOUBLE / 10), 4)::INTEGER AS b0, least(floor(l_discount::DOUBLE / (0.1e0 / 3)), 2)::INTEGER AS b1, least(floor(l_tax::DOUBLE / 0.04e0), 1)::INTEGER AS b2, count(*) AS count FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1 AND l_tax BETWEEN 0 AND 0.08 GROUP BY ALL")

_V = "(SELECT n_nationkey::BIGINT AS i, (n_nationkey * n_regionkey + 3)::DOUBLE AS x FROM nation)"
_vector = lambda f: f.select(F.col("n_nationkey").cast("bigint").alias("pos"), (F.col("n_nationkey") * F.col("n_regionkey") + 3).cast("double").alias("x"))
_SOURCE = {
    "edge": "greatest(0, least(24, k))", "wrap": "(k + 50) % 25", "reflect": "CASE WHEN (k + 48) % 48 > 24 THEN 48 - (k + 48) % 48 ELSE (k + 48) % 48 END",
    "symmetric": "CASE WHEN (k + 50) % 50 >= 25 THEN 49 - (k + 50) % 50 ELSE (k + 50) % 50 END",
}
for _mode, _source in _SOURCE.items():
    _add(f"pad_{_mode}", "nation", lambda f, m=_mode: select.pad_mode(_vector(f), "pos", "x", 4, 6, m), f"SELECT k + 4 AS pos, x FROM range(-4, 31) r(k) JOIN {_V} ON i = {_source}")
for _mode, _value in {"maximum": "(SELECT max(x) FROM v)", "minimum": "(SELECT min(x) FROM v)", "mean": "(SELECT avg(x) FROM v)", "median": "(SELECT median(x) FROM v)", "empty": "NULL"}.items():
    _add(f"pad_{_mode}", "nation", lambda f, m=_mode: select.pad_mode(_vector(f), "pos", "x", 4, 6, m).withColumn("x", F.round("x", 6)), f"WITH v AS {_V} SELECT k + 4 AS pos, round(CASE WHEN i IS NULL THEN {_value} ELSE x END, 6) AS x FROM range(-4, 31) r(k) LEFT JOIN v ON i = k")
_add("pad_linear_ramp", "nation", lambda f: select.pad_mode(_vector(f), "pos", "x", 4, 6, "linear_ramp", -5.0).withColumn("x", F.round("x", 6)),
     f"WITH v AS {_V} SELECT k + 4 AS pos, round(CASE WHEN k < 0 THEN x + (-5 - x) * -k / 4e0 WHEN k > 24 THEN x + (-5 - x) * (k - 24) / 6e0 ELSE x END, 6) AS x FROM range(-4, 31) r(k) JOIN v ON i = greatest(0, least(24, k))")
for _name, _weights in (("correlate", "w[4 - j]"), ("convolve", "w[j + 1]")):
    for _mode, _begin, _count in (("full", 0, 28), ("same", 1, 25), ("valid", 3, 22)):
        _add(f"{_name}_{_mode}", "nation", lambda f, n=_name, m=_mode: window.slide(_vector(f), "pos", "x", [1.0, -2.0, 0.5, 3.0], m, n == "convolve"),
             f"SELECT i + j - {_begin} AS pos, sum(x * {_weights}) AS y FROM {_V}, range(4) r(j), (SELECT [1.0::DOUBLE, -2, 0.5, 3] AS w) WHERE i + j - {_begin} BETWEEN 0 AND {_count - 1} GROUP BY 1")
_add("diagflat", "nation", lambda f: select.diagflat(_vector(f), "pos", "x", 25, -2), f"SELECT i + 2 AS i, i AS j, x FROM {_V}")
_add("compress", "nation", lambda f: select.compress(_vector(f), F.col("pos") % 3 == 1), f"SELECT i AS pos, x FROM {_V} WHERE i % 3 = 1")
for _name in ("nonzero", "flatnonzero"):
    _add(_name, "part", lambda f: select.nonzero(f.select("p_partkey", (F.col("p_size") % 4).alias("x")), ["p_partkey"], "x"), "SELECT p_partkey FROM part WHERE p_size % 4 <> 0")
_add("unique_values", "part", lambda f: sets.unique_values(f, "p_size"), "SELECT DISTINCT p_size FROM part")
_add("unique_all", "part", lambda f: sets.unique_all(f, "p_size", "p_partkey"), "SELECT p_size AS value, count(*) AS counts, min(p_partkey) AS index, row_number() OVER (ORDER BY p_size) - 1 AS inverse FROM part GROUP BY p_size")
