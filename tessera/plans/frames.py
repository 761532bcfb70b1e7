"""Queries of reductions, ordered operations, sorting, sets, selection, products and masks over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import poly
from tessera.operators import masked, reduce, select, sets, sort, tensor, window

QUERIES, ORACLES = {}, {}


def _add(name, table, run, sql):
    def query(spark, sf_dir):
        return run(spark.read.parquet(f"{sf_dir}/{table}.parquet"), lambda other: spark.read.parquet(f"{sf_dir}/{other}.parquet"))

    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# Reductions of prices by return flag; NaN stands in for quantities of 13 in the nan family.
_NAN = "CASE WHEN l_quantity = 13 THEN NULL ELSE l_quantity END"
_REDUCTIONS = {
    "sum": "sum(x)", "mean": "avg(x)", "var": "var_pop(x)", "std": "stddev_pop(x)", "var_sample": "var_samp(x)", "std_sample": "stddev_samp(x)",
    "max": "max(x)", "min": "min(x)", "ptp": "max(x) - min(x)", "median": "median(x)", "size": "count(x)", "count_nonzero": "count(*) FILTER (x <> 0)",
    "any": "bool_or(x <> 0)", "all": "bool_and(x <> 0)",
}
_EXACT = ("size", "count_nonzero", "any", "all", "max", "min")
for _name, _sql in _REDUCTIONS.items():
    _add(
        f"reduce_{_name}",
        "lineitem",
        lambda f, _, n=_name: (lambda g: g if n in _EXACT else g.withColumn("y", F.round("y", 4)))(reduce.reduce_axis(f, n, "l_extendedprice" if n not in ("any", "all", "count_nonzero") else "l_discount", ["l_returnflag"], "y")),
        f"SELECT l_returnflag, {_sql if _name in _EXACT else f'round({_sql}, 4)'} AS y FROM (SELECT l_returnflag, {'l_extendedprice' if _name not in ('any', 'all', 'count_nonzero') else 'l_discount'} AS x FROM lineitem) GROUP BY l_returnflag",
    )
for _name, _sql in {"nansum": "sum(x)", "nanmean": "avg(x)", "nanvar": "var_pop(x)", "nanstd": "stddev_pop(x)", "nanmax": "max(x)", "nanmin": "min(x)", "nanmedian": "median(x)"}.items():
    _add(
        f"reduce_{_name}",
        "lineitem",
        lambda f, _, n=_name: reduce.reduce_axis(f.withColumn("x", F.when(F.col("l_quantity") == 13, float("nan")).otherwise(F.col("l_quantity"))), n, "x", ["l_linestatus"], "y").withColumn("y", F.round("y", 4)),
        f"SELECT l_linestatus, round({_sql}, 4) AS y FROM (SELECT l_linestatus, {_NAN} AS x FROM lineitem) GROUP BY l_linestatus",
    )
_add("reduce_prod", "nation", lambda f, _: reduce.reduce_axis(f, "prod", "n_nationkey", ["n_regionkey"], "y").withColumn("y", F.round("y", 2)), "SELECT n_regionkey, round(product(n_nationkey), 2) AS y FROM nation GROUP BY n_regionkey")
_add("reduce_nanprod", "nation", lambda f, _: reduce.reduce_axis(f, "nanprod", "n_nationkey", ["n_regionkey"], "y").withColumn("y", F.round("y", 2)), "SELECT n_regionkey, round(product(n_nationkey), 2) AS y FROM nation GROUP BY n_regionkey")
_add("reduce_logsumexp", "orders", lambda f, _: reduce.logsumexp(f.withColumn("x", F.col("o_totalprice") / 50000), "x", ["o_orderpriority"], "y").withColumn("y", F.round("y", 6)), "SELECT o_orderpriority, round(max(t) + ln(sum(exp(x - t))), 6) AS y FROM (SELECT o_orderpriority, x, max(x) OVER (PARTITION BY o_orderpriority) AS t FROM (SELECT o_orderpriority, o_totalprice / 50000 AS x FROM orders)) GROUP BY o_orderpriority")
_add("reduce_argmax", "orders", lambda f, _: reduce.arg_extreme(f, "o_totalprice", "o_orderkey", ["o_orderstatus"], True), "SELECT o_orderstatus, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS position FROM orders GROUP BY o_orderstatus")
_add("reduce_argmin", "orders", lambda f, _: reduce.arg_extreme(f, "o_totalprice", "o_orderkey", ["o_orderstatus"], False), "SELECT o_orderstatus, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS position FROM orders GROUP BY o_orderstatus")
_add("reduce_average", "lineitem", lambda f, _: reduce.average(f, "l_extendedprice", "l_quantity", ["l_returnflag"], "y").withColumn("y", F.round("y", 4)), "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS y FROM lineitem GROUP BY l_returnflag")
_add("reduce_two_axes", "lineitem", lambda f, _: f.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(reduce.variance(F.col("l_tax")), 8).alias("variance")), "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean, round(var_pop(l_tax), 8) AS variance FROM lineitem GROUP BY ALL")
_add("cov_corrcoef", "lineitem", lambda f, _: reduce.moments(f, "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("cov", 3).alias("cov"), F.round("corrcoef", 8).alias("corrcoef")), "SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 3) AS cov, round(corr(l_quantity, l_extendedprice), 8) AS corrcoef FROM lineitem GROUP BY l_returnflag")

# The 13 quantile definitions, at q = 0.3 of order prices by status.
_PLACE = {
    "linear": "1 + 0.3 * (n - 1)", "hazen": "0.5 + 0.3 * n", "weibull": "0.3 * (n + 1)", "interpolated_inverted_cdf": "0.3 * n",
    "median_unbiased": "1e0 / 3 + 0.3 * (n + 1e0 / 3)", "normal_unbiased": "3e0 / 8 + 0.3 * (n + 1e0 / 4)", "lower": "floor(0.3 * (n - 1)) + 1", "higher": "ceil(0.3 * (n - 1)) + 1",
    "nearest": "round_even(0.3 * (n - 1), 0) + 1", "midpoint": "floor(0.3 * (n - 1)) + 1 + CASE WHEN 0.3 * (n - 1) > floor(0.3 * (n - 1)) THEN 0.5 ELSE 0 END",
    "inverted_cdf": "ceil(0.3 * n)", "averaged_inverted_cdf": "ceil(0.3 * n) + CASE WHEN 0.3 * n = floor(0.3 * n) THEN 0.5 ELSE 0 END", "closest_observation": "round_even(0.3 * n, 0)",
}
for _name, _place in _PLACE.items():
    _sql = f"""WITH r AS (SELECT o_orderstatus AS s, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS r, (count(*) OVER (PARTITION BY o_orderstatus))::DOUBLE AS n FROM orders),
    p AS (SELECT DISTINCT s, greatest(1, least(n, ({_place.replace('0.3', '0.3e0')})::DOUBLE)) AS p FROM r)
    SELECT s AS o_orderstatus, round(max(CASE WHEN r = floor(p) THEN x END) + CASE WHEN max(p) > floor(max(p)) THEN (max(CASE WHEN r = floor(p) + 1 THEN x END) - max(CASE WHEN r = floor(p) THEN x END)) * (max(p) - floor(max(p))) ELSE 0 END, 4) AS q
    FROM r JOIN p USING (s) GROUP BY s"""
    _add(f"quantile_{_name}", "orders", lambda f, _, n=_name: reduce.quantile(f, "o_totalprice", 0.3, ["o_orderstatus"], n, "q").withColumn("q", F.round("q", 4)), _sql)

_add("histogram", "lineitem", lambda f, _: reduce.histogram(f, "l_quantity", 7, 0.0, 50.0), "SELECT b.range::INTEGER AS bin, count(x) AS count FROM range(7) b LEFT JOIN (SELECT least(floor(l_quantity / (50.0 / 7)), 6) AS x FROM lineitem WHERE l_quantity BETWEEN 0 AND 50) ON x = b.range GROUP BY 1")
_add("histogram2d", "lineitem", lambda f, _: reduce.histogram2d(f, "l_quantity", "l_tax", (5, 4), ((0.0, 50.0), (0.0, 0.1))), "SELECT least(floor(l_quantity / (50e0 / 5)), 4)::INTEGER AS i, least(floor(l_tax / (0.1e0 / 4)), 3)::INTEGER AS j, count(*) AS count FROM lineitem GROUP BY ALL")
_add("bincount", "part", lambda f, _: reduce.bincount(f, "p_size"), "SELECT r.range AS value, count(p_size) AS count FROM range((SELECT max(p_size) + 1 FROM part)) r LEFT JOIN part ON p_size = r.range GROUP BY 1")
_add("digitize", "part", lambda f, _: f.select("p_partkey", reduce.digitize(F.col("p_size"), [10, 20, 30, 40]).alias("bin")), "SELECT p_partkey, ((p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 30)::INT + (p_size >= 40)::INT)::INTEGER AS bin FROM part")
_add("searchsorted", "part", lambda f, _: f.select("p_partkey", sort.searchsorted([10, 20, 30, 40], F.col("p_size")).alias("place")), "SELECT p_partkey, ((p_size > 10)::INT + (p_size > 20)::INT + (p_size > 30)::INT + (p_size > 40)::INT)::INTEGER AS place FROM part")

# Ordered operations on event values of each user.
_KEYS, _ORDER = ["user_id"], ["ts", "event_id"]
_OVER = "(PARTITION BY user_id ORDER BY ts, event_id {})"
_WINDOWS = {
    "cumsum": (lambda x, w: window.running("cumsum", x, w), "sum(value) OVER " + _OVER.format("ROWS UNBOUNDED PRECEDING")),
    "cummax": (lambda x, w: window.running("cummax", x, w), "max(value) OVER " + _OVER.format("ROWS UNBOUNDED PRECEDING")),
    "cummin": (lambda x, w: window.running("cummin", x, w), "min(value) OVER " + _OVER.format("ROWS UNBOUNDED PRECEDING")),
    "cummean": (lambda x, w: window.running("cummean", x, w), "avg(value) OVER " + _OVER.format("ROWS UNBOUNDED PRECEDING")),
    "cumprod": (lambda x, w: window.running("cumprod", x / 10000 + 0.995, w), "exp(sum(ln(value / 10000 + 0.995)) OVER " + _OVER.format("ROWS UNBOUNDED PRECEDING") + ")"),
    "diff": (lambda x, w: window.diff(x, w), "value - lag(value) OVER " + _OVER.format("")),
    "gradient": (lambda x, w: window.gradient(x, w), f"CASE WHEN lag(value) OVER {_OVER.format('')} IS NULL THEN lead(value) OVER {_OVER.format('')} - value WHEN lead(value) OVER {_OVER.format('')} IS NULL THEN value - lag(value) OVER {_OVER.format('')} ELSE (lead(value) OVER {_OVER.format('')} - lag(value) OVER {_OVER.format('')}) / 2 END"),
    "sliding_mean": (lambda x, w: window.sliding(F.avg, x, w, 3), "CASE WHEN count(*) OVER " + _OVER.format("ROWS 2 PRECEDING") + " = 3 THEN avg(value) OVER " + _OVER.format("ROWS 2 PRECEDING") + " END"),
    "convolve": (lambda x, w: window.convolve(x, [0.5, 0.3, 0.2], w), f"value * 0.5 + coalesce(lag(value) OVER {_OVER.format('')}, 0) * 0.3 + coalesce(lag(value, 2) OVER {_OVER.format('')}, 0) * 0.2"),
    "anom": (lambda x, w: masked.anom(x, _KEYS), "value - avg(value) OVER (PARTITION BY user_id)"),
}
for _name, (_make, _sql) in _WINDOWS.items():
    _add(
        f"window_{_name}",
        "events",
        lambda f, _, m=_make: f.withColumn("y", m(F.col("value"), window.ordered(_KEYS, _ORDER))).select("event_id", F.round("y", 8).alias("y")),
        _sql and f"SELECT event_id, round({_sql}, 8) AS y FROM events",
    )
_add("window_affine_scan", "events", lambda f, _: window.affine_scan(f, F.lit(0.9), F.col("value"), _KEYS, _ORDER).select("event_id", F.round(F.round(F.col("y") * 0.7071067811865476, 4), 8).alias("y")), None)
ORACLES["window_affine_scan"] = "SELECT event_id, round(sum(value * pow(0.9, -i)) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) * pow(0.9, i) * 0.7071067811865476, 4) AS y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
_add("trapezoid", "events", lambda f, _: window.trapezoid(f.withColumn("x", F.col("event_id").cast("double")), "value", "x", _KEYS).withColumn("area", F.round("area", 4)), "SELECT user_id, round(coalesce(sum(a), 0), 4) AS area FROM (SELECT user_id, (event_id - lag(event_id) OVER w) * (value + lag(value) OVER w) / 2 AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id")
_add("positions", "customer", lambda f, _: window.with_positions(f.select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "pos"), "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos FROM customer")
_add("interp", "part", lambda f, t: window.interpolate(f.select("p_partkey", "p_retailprice"), t("supplier").select((F.col("s_suppkey") * 20 + 900).alias("xp"), "s_acctbal"), "p_retailprice", "xp", "s_acctbal").select("p_partkey", F.round(F.col("y") / 3, 6).alias("y")),
     """WITH k AS (SELECT (s_suppkey * 20 + 900)::DOUBLE AS xp, s_acctbal AS fp, lead((s_suppkey * 20 + 900)::DOUBLE) OVER (ORDER BY s_suppkey) AS xn, lead(s_acctbal) OVER (ORDER BY s_suppkey) AS fn FROM supplier),
     e AS (SELECT min(xp) AS lo, arg_min(fp, xp) AS flo FROM k)
     SELECT p_partkey, round((CASE WHEN p_retailprice < lo THEN flo WHEN xn IS NULL OR p_retailprice = xp THEN fp ELSE fp + (fn - fp) * (p_retailprice - xp) / (xn - xp) END) / 3, 6) AS y FROM part CROSS JOIN e ASOF LEFT JOIN k ON p_retailprice >= xp""")  # fmt: skip

# Sorting and ranking.
_add("argsort", "customer", lambda f, _: sort.argsort(f, "c_acctbal", "c_custkey", ["c_mktsegment"]), "SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS rank, c_custkey AS position FROM customer")
_add("lexsort", "customer", lambda f, _: sort.lexsort(f, ["c_acctbal", "c_nationkey"], "c_custkey", ["c_mktsegment"]), "SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_acctbal, c_custkey) - 1 AS rank, c_custkey AS position FROM customer")
_add("sort", "supplier", lambda f, _: sort.sort(f.select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey"), "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
_add("partition_smallest", "customer", lambda f, _: sort.smallest(f.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", 5, ["c_mktsegment"], tie="c_custkey"), "SELECT c_custkey, c_mktsegment, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS r FROM customer) WHERE r <= 5")
_add("partition_largest", "orders", lambda f, _: sort.smallest(f.select("o_orderkey", "o_totalprice"), "o_totalprice", 20, largest=True, tie="o_orderkey"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")

# Sets.
_add("unique_counts", "part", lambda f, _: sets.unique(f, "p_brand", "p_partkey"), 'SELECT p_brand AS value, count(*) AS counts, min(p_partkey) AS "index" FROM part GROUP BY p_brand')
_add("unique_inverse", "part", lambda f, _: sets.unique_inverse(f.select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "inverse"), "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS inverse FROM part")
_add("isin", "customer", lambda f, t: sets.isin(f.select("c_custkey"), "c_custkey", t("orders").select("o_custkey"), "o_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
_add("isin_invert", "customer", lambda f, t: sets.isin(f.select("c_custkey"), "c_custkey", t("orders").select("o_custkey"), "o_custkey", invert=True), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_SIDES = lambda f, t: (f.select((F.col("c_custkey") % 400).alias("x")), t("part").select(F.col("p_size").cast("bigint").alias("x")))
for _name, _op, _sql in (("intersect1d", sets.intersect1d, "INTERSECT"), ("union1d", sets.union1d, "UNION"), ("setdiff1d", sets.setdiff1d, "EXCEPT")):
    _add(_name, "customer", lambda f, t, op=_op: op(*_SIDES(f, t)), f"SELECT c_custkey % 400 AS x FROM customer {_sql} SELECT p_size::BIGINT AS x FROM part")
_add("setxor1d", "customer", lambda f, t: sets.setxor1d(*_SIDES(f, t)), "WITH a AS (SELECT DISTINCT c_custkey % 400 AS x FROM customer), b AS (SELECT DISTINCT p_size::BIGINT AS x FROM part) SELECT x FROM a WHERE x NOT IN (SELECT x FROM b) UNION ALL SELECT x FROM b WHERE x NOT IN (SELECT x FROM a)")
_POS = lambda f: f.select((F.col("n_nationkey")).cast("bigint").alias("pos"), F.col("n_name").alias("x"))
_add("concatenate", "nation", lambda f, t: sets.concatenate([_POS(f), t("region").select(F.col("r_regionkey").cast("bigint").alias("pos"), F.col("r_name").alias("x"))], "pos"), "SELECT n_nationkey::BIGINT AS pos, n_name AS x FROM nation UNION ALL SELECT r_regionkey + (SELECT count(*) FROM nation), r_name FROM region")

# Selection and movement.
_add("where", "lineitem", lambda f, _: f.select(F.round(F.sum(select.where(F.col("l_discount") > 0.05, F.col("l_tax"), F.col("l_discount"))), 4).alias("y")), "SELECT round(sum(CASE WHEN l_discount > 0.05 THEN l_tax ELSE l_discount END), 4) AS y FROM lineitem")
_add("select", "part", lambda f, _: f.select("p_partkey", select.select([F.col("p_size") < 10, F.col("p_size") < 30], [F.lit("small"), F.lit("middle")], F.lit("large")).alias("y")), "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS y FROM part")
_add("choose", "part", lambda f, _: f.select("p_partkey", select.choose(F.col("p_size"), [F.lit("a"), F.lit("b"), F.lit("c")], "wrap").alias("y")), "SELECT p_partkey, ['a', 'b', 'c'][p_size % 3 + 1] AS y FROM part")
_add("choose_clip", "part", lambda f, _: f.select("p_partkey", select.choose(F.col("p_size") - 20, [F.lit("a"), F.lit("b"), F.lit("c")], "clip").alias("y")), "SELECT p_partkey, ['a', 'b', 'c'][greatest(0, least(2, p_size - 20)) + 1] AS y FROM part")
_add("clip", "part", lambda f, _: f.select("p_partkey", select.clip(F.col("p_retailprice"), 1000.0, 1500.0).alias("y")), "SELECT p_partkey, least(greatest(p_retailprice, 1000.0), 1500.0)::DOUBLE AS y FROM part")
_add("take", "nation", lambda f, t: select.take(_POS(f), "pos", t("supplier").select(F.col("s_nationkey").cast("bigint").alias("i"), "s_suppkey"), "i").select("s_suppkey", "x"), "SELECT s_suppkey, n_name AS x FROM supplier JOIN nation ON n_nationkey = s_nationkey")
_add("flip", "nation", lambda f, _: select.reversed_positions(_POS(f), "pos"), "SELECT (SELECT count(*) FROM nation) - 1 - n_nationkey AS pos, n_name AS x FROM nation")
_add("roll", "nation", lambda f, _: select.roll(_POS(f), "pos", 3), "SELECT (n_nationkey + 3) % (SELECT count(*) FROM nation) AS pos, n_name AS x FROM nation")
_add("repeat", "nation", lambda f, _: select.repeat(_POS(f), "pos", 3), "SELECT n_nationkey::BIGINT * 3 + k.range AS pos, n_name AS x FROM nation, range(3) k")
_add("tile", "nation", lambda f, _: select.tile(_POS(f), "pos", 2), "SELECT n_nationkey + k.range * (SELECT count(*) FROM nation) AS pos, n_name AS x FROM nation, range(2) k")
_add("pad", "nation", lambda f, _: select.pad(_POS(f), "pos", "x", 2, 3, "-"), "SELECT n_nationkey::BIGINT + 2 AS pos, n_name AS x FROM nation UNION ALL SELECT range, '-' FROM range(2) UNION ALL SELECT range + 2 + (SELECT count(*) FROM nation), '-' FROM range(3)")

# Products of coordinate frames: A and B are order counts and sums by nation, segment and priority.
_A = lambda f: f.groupBy((F.col("l_suppkey") % 7).alias("i"), (F.col("l_partkey") % 5).alias("j")).agg(F.sum("l_linenumber").alias("x"))
_B = lambda f: f.groupBy((F.col("l_partkey") % 5).alias("i"), (F.col("l_orderkey") % 6).alias("j")).agg(F.sum("l_linenumber").alias("x"))
_AB = "WITH a AS (SELECT l_suppkey % 7 AS i, l_partkey % 5 AS j, sum(l_linenumber) AS x FROM lineitem GROUP BY ALL), b AS (SELECT l_partkey % 5 AS i, l_orderkey % 6 AS j, sum(l_linenumber) AS x FROM lineitem GROUP BY ALL) "
_IJ = ("i", "j")
_add("matmul", "lineitem", lambda f, _: tensor.matmul(_A(f), _B(f)), _AB + "SELECT a.i, b.j AS k, sum(a.x * b.x)::BIGINT AS x FROM a JOIN b ON a.j = b.i GROUP BY ALL")
_add("einsum_hadamard_sum", "lineitem", lambda f, _: tensor.einsum("ij,ij->i", (_A(f), _IJ, "x"), (_A(f), _IJ, "x")), _AB + "SELECT i, sum(x * x)::BIGINT AS i2 FROM a GROUP BY i".replace("i2", "x"))
_add("einsum_chain", "lineitem", lambda f, _: tensor.einsum("ij,jk,kl->il", (_A(f), _IJ, "x"), (_B(f), _IJ, "x"), (_A(f), _IJ, "x"), exact=True), _AB + "SELECT a.i, c.j AS l, sum(a.x * b.x * c.x)::BIGINT AS x FROM a JOIN b ON a.j = b.i JOIN a c ON c.i = b.j GROUP BY ALL")
_add("einsum_diagonal", "lineitem", lambda f, _: tensor.einsum("ii->i", (_A(f), _IJ, "x")), _AB + "SELECT i, x::BIGINT AS x FROM a WHERE i = j")
_add("trace", "lineitem", lambda f, _: tensor.trace(_A(f)), _AB + "SELECT sum(x)::BIGINT AS x FROM a WHERE i = j")
_add("outer", "lineitem", lambda f, _: tensor.outer(tensor.einsum("ij->i", (_A(f), _IJ, "x")), tensor.einsum("ij->j", (_A(f), _IJ, "x")).withColumnRenamed("j", "i")), _AB + "SELECT p.i, q.j, (p.x * q.x)::BIGINT AS x FROM (SELECT i, sum(x) AS x FROM a GROUP BY i) p, (SELECT j, sum(x) AS x FROM a GROUP BY j) q")
_add("inner", "lineitem", lambda f, _: tensor.einsum("ij,ij->", (_A(f), _IJ, "x"), (_A(f), _IJ, "x")), _AB + "SELECT sum(x * x)::BIGINT AS x FROM a")
_add("transpose", "lineitem", lambda f, _: tensor.transpose(_A(f), _IJ, (1, 0)), _AB + "SELECT j AS i, i AS j, x::BIGINT AS x FROM a")
_add("tril", "lineitem", lambda f, _: tensor.triangle(_A(f)), _AB + "SELECT i, j, x::BIGINT AS x FROM a WHERE j <= i")
_add("triu", "lineitem", lambda f, _: tensor.triangle(_A(f), lower=False), _AB + "SELECT i, j, x::BIGINT AS x FROM a WHERE j >= i")
_add("kron", "lineitem", lambda f, _: tensor.kron(_A(f), _B(f), (5, 6)), _AB + "SELECT a.i * 5 + b.i AS i, a.j * 6 + b.j AS j, (a.x * b.x)::BIGINT AS x FROM a, b")
_add("gram_of_embeddings", "embeddings", lambda f, _: tensor.einsum("ij,ik->jk", *[(tensor.rows_to_coordinates(f, "vec_id", "embedding"), _IJ, "x")] * 2).withColumn("x", F.round("x", 3) + 0.0), "WITH c AS (SELECT vec_id AS i, unnest(range(len(embedding)))::INTEGER AS j, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT a.j, b.j AS k, round(sum(a.x * b.x), 3) + 0.0 AS x FROM c a JOIN c b USING (i) GROUP BY ALL")

# Masks: NULL is masked.
_V = F.col
_add("masked_outside_mean", "events", lambda f, _: f.groupBy("event_type").agg(F.round(F.avg(masked.masked_outside(_V("value"), 10, 60)), 5).alias("mean"), masked.count(masked.masked_outside(_V("value"), 10, 60)).alias("n")), "SELECT event_type, round(avg(value) FILTER (value BETWEEN 10 AND 60), 5) AS mean, count(*) FILTER (value BETWEEN 10 AND 60) AS n FROM events GROUP BY event_type")
_add("masked_inside", "events", lambda f, _: f.select("event_id", masked.filled(masked.masked_inside(_V("value"), 10, 60), -1.0).alias("y")), "SELECT event_id, CASE WHEN value BETWEEN 10 AND 60 THEN -1.0 ELSE value END::DOUBLE AS y FROM events")
_add("masked_where", "events", lambda f, _: masked.compressed(f.select("event_id", masked.masked_where(_V("event_type") == "click", _V("value")).alias("y")), "y"), "SELECT event_id, value AS y FROM events WHERE event_type <> 'click' AND value IS NOT NULL")
_add("masked_clumps", "events", lambda f, _: masked.clump_unmasked(f.select("event_id", masked.masked_outside(_V("value"), 10, 60).alias("y")), "y", "event_id", []), 'SELECT min(event_id) AS "first", max(event_id) AS "last" FROM (SELECT event_id, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE value BETWEEN 10 AND 60) GROUP BY g')

# Polynomials as expressions.
_X = lambda f: ((F.col("p_size") - 25) / F.lit(25.0))
_S = "((p_size - 25) / 25e0)"
_SERIES = {
    "polyval": (poly.polyval, f"1 + 2 * {_S} + 3 * pow({_S}, 2) + 4 * pow({_S}, 3)"),
    "chebval": (poly.chebval, f"1 + 2 * {_S} + 3 * (2 * pow({_S}, 2) - 1) + 4 * (4 * pow({_S}, 3) - 3 * {_S})"),
    "legval": (poly.legval, f"1 + 2 * {_S} + 3 * (3 * pow({_S}, 2) - 1) / 2 + 4 * (5 * pow({_S}, 3) - 3 * {_S}) / 2"),
    "hermval": (poly.hermval, f"1 + 2 * 2 * {_S} + 3 * (4 * pow({_S}, 2) - 2) + 4 * (8 * pow({_S}, 3) - 12 * {_S})"),
    "hermeval": (poly.hermeval, f"1 + 2 * {_S} + 3 * (pow({_S}, 2) - 1) + 4 * (pow({_S}, 3) - 3 * {_S})"),
    "lagval": (poly.lagval, f"1 + 2 * (1 - {_S}) + 3 * (pow({_S}, 2) - 4 * {_S} + 2) / 2 + 4 * (-pow({_S}, 3) + 9 * pow({_S}, 2) - 18 * {_S} + 6) / 6"),
}
for _name, (_make, _sql) in _SERIES.items():
    _add(f"poly_{_name}", "part", lambda f, _, m=_make: f.select("p_partkey", F.round(m(_X(f), [1.0, 2.0, 3.0, 4.0]), 6).alias("y")), f"SELECT p_partkey, round({_sql}, 6) AS y FROM part")
