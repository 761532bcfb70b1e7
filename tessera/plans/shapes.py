"""Queries of shape changes, windows of signals, and unwrapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import signal
from tessera.operators import shape, window

QUERIES, ORACLES = {}, {}


def _add(name, table, run, sql):
    QUERIES[name] = lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    ORACLES[name] = sql


_NATION = lambda f: f.select(F.col("n_nationkey").cast("bigint").alias("pos"), F.col("n_name").alias("x"))
_N = "(SELECT n_nationkey::BIGINT AS pos, n_name AS x FROM nation)"
_add("insert", "nation", lambda f: shape.insert(_NATION(f), "pos", "x", 4, "new"), f"SELECT pos + (pos >= 4)::INT AS pos, x FROM {_N} UNION ALL SELECT 4, 'new'")
_add("delete", "nation", lambda f: shape.delete(_NATION(f), "pos", [2, 7, 7]), f"SELECT pos - (pos > 2)::INT - (pos > 7)::INT AS pos, x FROM {_N} WHERE pos NOT IN (2, 7)")
_add("slice", "nation", lambda f: shape.cut(_NATION(f), "pos", 3, 20, 4), f"SELECT (pos - 3) // 4 AS pos, x FROM {_N} WHERE pos BETWEEN 3 AND 19 AND (pos - 3) % 4 = 0")
_add("array_split", "nation", lambda f: shape.array_split(_NATION(f), "pos", 4).select("pos", "part", "inside"), f"WITH s AS (SELECT count(*) AS n FROM nation) SELECT pos, p AS part, pos - CASE WHEN p < n % 4 THEN p * (n // 4 + 1) ELSE (n % 4) * (n // 4 + 1) + (p - n % 4) * (n // 4) END AS inside FROM (SELECT pos, n, CASE WHEN pos < (n // 4 + 1) * (n % 4) THEN pos // (n // 4 + 1) ELSE n % 4 + (pos - (n // 4 + 1) * (n % 4)) // (n // 4) END AS p FROM {_N}, s)")
_add("trim_zeros", "part", lambda f: shape.trim_zeros(f.select(F.col("p_partkey").alias("pos"), F.when((F.col("p_partkey") > 5) & (F.col("p_partkey") < 150), F.col("p_size")).otherwise(0).alias("x")), "pos", "x"), "WITH v AS (SELECT p_partkey AS pos, CASE WHEN p_partkey > 5 AND p_partkey < 150 THEN p_size ELSE 0 END AS x FROM part), e AS (SELECT min(pos) AS lo, max(pos) AS hi FROM v WHERE x <> 0) SELECT pos - lo AS pos, x FROM v, e WHERE pos BETWEEN lo AND hi")
_GRID = lambda f: f.groupBy((F.col("l_suppkey") % 4).alias("i"), (F.col("l_partkey") % 6).alias("j")).agg(F.sum("l_linenumber").alias("x"))
_G = "(SELECT l_suppkey % 4 AS i, l_partkey % 6 AS j, sum(l_linenumber)::BIGINT AS x FROM lineitem GROUP BY ALL)"
_add("reshape", "lineitem", lambda f: shape.reshape(_GRID(f), ["i", "j"], [4, 6], ["a", "b", "c"], [2, 3, 4]), f"SELECT (i * 6 + j) // 12 AS a, ((i * 6 + j) // 4) % 3 AS b, (i * 6 + j) % 4 AS c, x FROM {_G}")
_add("rot90", "lineitem", lambda f: shape.rot90(_GRID(f), (4, 6)), f"SELECT 5 - j AS i, i AS j, x FROM {_G}")
_add("diagonal", "lineitem", lambda f: shape.diagonal(_GRID(f), offset=1), f"SELECT least(i, j) AS i, x FROM {_G} WHERE j - i = 1")
_add("diag", "nation", lambda f: shape.diag(_NATION(f).withColumnRenamed("pos", "i"), "i", 2), f"SELECT pos AS i, pos + 2 AS j, x FROM {_N}")
_add("meshgrid", "region", lambda f: shape.meshgrid(f.select(F.col("r_regionkey").alias("i")), f.select(F.col("r_regionkey").alias("j"))), "SELECT a.r_regionkey AS i, b.r_regionkey AS j FROM region a, region b")
_add("extract", "part", lambda f: shape.extract(f.select("p_partkey", "p_size"), F.col("p_size") > 45, "p_partkey"), "SELECT p_partkey, p_size FROM part WHERE p_size > 45")
_ANGLE = "2 * pi() * pos / (n - 1)"
_SHAPES = {"hanning": f"0.5 - 0.5 * cos({_ANGLE})", "hamming": f"0.54 - 0.46 * cos({_ANGLE})", "blackman": f"0.42 - 0.5 * cos({_ANGLE}) + 0.08 * cos(2 * {_ANGLE})", "bartlett": "1 - abs(2.0 * pos / (n - 1) - 1)"}


def _windowed(events, name):
    """All events' values in order of time, under a window as long as they are."""
    placed = window.with_positions(events.select("event_id", "ts", "value"), ["ts", "event_id"])
    return placed.join(signal.shape(events.sparkSession, name, events.count()), "pos").select("event_id", (F.round(F.col("x") * F.col("value"), 6) + 0.0).alias("x"))


for _name, _sql in _SHAPES.items():
    _add(f"signal_{_name}", "events", lambda f, n=_name: _windowed(f, n), f"SELECT event_id, round(({_sql}) * value, 6) + 0.0 AS x FROM (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)")


def _unwrap(events):
    over = window.ordered(["user_id"], ["ts", "event_id"])
    turned = events.withColumn("x", F.col("value") % 6.0).withColumn("step", signal.unwrap(F.col("x"), over, 6.0))
    return turned.withColumn("y", F.col("x") + window.running("cumsum", F.col("step"), over)).select("event_id", (F.round("y", 4) + 0.0).alias("y"))


_add("unwrap", "events", _unwrap, """WITH d AS (SELECT *, x - lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS jump FROM (SELECT *, fmod(value, 6.0) AS x FROM events)),
s AS (SELECT *, CASE WHEN jump IS NULL OR abs(jump) < 3 THEN 0 ELSE CASE WHEN jump + 3 - floor((jump + 3) / 6) * 6 - 3 = -3 AND jump > 0 THEN 3 ELSE jump + 3 - floor((jump + 3) / 6) * 6 - 3 END - jump END AS step FROM d)
SELECT event_id, round(x + sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS y FROM s""")
