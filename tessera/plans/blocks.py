"""Queries of blocked products, orders of contraction, tall QR and least squares."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import blocks, tensor
from tessera.operators.window import with_positions

QUERIES, ORACLES = {}, {}


def _add(name, tables, run, sql):
    QUERIES[name] = lambda spark, sf_dir: run(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()))
    ORACLES[name] = sql


def _vectors(embeddings) -> blocks.Blocks:
    rows = with_positions(embeddings.select("vec_id", "embedding"), ["vec_id"], "i")
    return blocks.from_rows(rows, "i", "embedding", (embeddings.count(), 64), 48)


def _rounded(frame, digits=3):
    return frame.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.round("x", digits) + 0.0).alias("x"))


def _near(frame, digits):
    """As _rounded, halves away from zero too, in doubles as the SQL rounds: without decimals, for products of many cells."""
    scale = 10.0**digits
    size = F.abs("x") * scale
    whole = F.rint(size)
    near = F.signum("x") * F.when(size - whole == 0.5, whole + 1).otherwise(whole) / scale
    x = F.when(size < 2.0**52, near).otherwise(F.col("x")) + 0.0  # beyond that, and infinite, there is nothing to round
    return frame.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), x.alias("x"))


_ROWS = "(SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS i, embedding AS v FROM embeddings)"
_CELLS = f"(SELECT i, unnest(range(64)) AS j, unnest(v)::DOUBLE AS x FROM {_ROWS})"
_GRAM = f"(SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS x FROM {_CELLS} a JOIN {_CELLS} b USING (i) GROUP BY ALL)"
_add("blocked_gram", "embeddings", lambda e: (lambda b: _rounded(blocks.to_coordinates(blocks.matmul(b.T, b))))(_vectors(e)), f"SELECT i, j, round(x, 3) + 0.0 AS x FROM {_GRAM}")
_add(
    "blocked_outer_gram",
    "embeddings",
    lambda e: (lambda b: _near(blocks.to_coordinates(blocks.matmul(b, b.T)).filter("i % 7 <= j % 7"), 4))(_vectors(e)),
    f"SELECT a.i, b.i AS j, round(list_sum([z[1]::DOUBLE * z[2]::DOUBLE FOR z IN list_zip(a.v, b.v)]), 4) + 0.0 AS x FROM {_ROWS} a, {_ROWS} b WHERE a.i % 7 <= b.i % 7",
)
_add("blocked_transpose", "embeddings", lambda e: _rounded(blocks.to_coordinates(_vectors(e).T), 6), f"SELECT j AS i, i AS j, round(x, 6) + 0.0 AS x FROM {_CELLS}")
_add("blocked_power", "embeddings", lambda e: (lambda g: _rounded(blocks.to_coordinates(blocks.matmul(g, g)), 1))((lambda b: blocks.matmul(b.T, b))(_vectors(e))),
     f"WITH g AS MATERIALIZED (SELECT * FROM {_GRAM}) SELECT a.i, b.j, round(sum(a.x * b.x), 1) + 0.0 AS x FROM g a JOIN g b ON a.j = b.i GROUP BY ALL")

# Four tensors of line items: suppliers by lines, lines by months, months by quantities, quantities by flags.
_PAIRS = {"ij": ("l_suppkey % 40", "l_linenumber - 1"), "jk": ("l_linenumber - 1", "month(l_shipdate) - 1"), "kl": ("month(l_shipdate) - 1", "l_quantity::BIGINT % 30"), "lm": ("l_quantity::BIGINT % 30", "ascii(l_returnflag) % 3")}


def _pair(lines, labels):
    a, b = (e.replace("l_quantity::BIGINT", "cast(l_quantity as bigint)") for e in _PAIRS[labels])
    return lines.selectExpr(f"{a} AS a", f"{b} AS b", "l_discount").groupBy("a", "b").agg(F.sum("l_discount").alias("x")), ["a", "b"], "x"


def _pair_sql(labels):
    a, b = _PAIRS[labels]
    return f"(SELECT {a} AS {labels[0]}, {b} AS {labels[1]}, sum(l_discount) AS x FROM lineitem GROUP BY ALL)"


_CHAIN = " JOIN ".join(f"{_pair_sql(p)} t{n}" + (f" USING ({p[0]})" if n else "") for n, p in enumerate(_PAIRS))
_product = lambda lines, **options: tensor.einsum("ij,jk,kl,lm->im", *(_pair(lines, p) for p in _PAIRS), **options)
_add("einsum_chain_of_four", "lineitem", lambda f: _product(f, optimize=True).select(F.col("i").cast("long").alias("i"), F.col("m").cast("long").alias("j"), F.round("x", 2).alias("x")),
     f"SELECT i::BIGINT AS i, m::BIGINT AS j, round(sum(t0.x * t1.x * t2.x * t3.x), 2) AS x FROM {_CHAIN} GROUP BY ALL")


def _path(lines):
    path, products = tensor.einsum_path("ij,jk,kl,lm->im", *(_pair(lines, p) for p in _PAIRS))
    spark = lines.sparkSession
    return spark.range(len(path)).select(F.col("id").alias("step"), *[F.get(F.array(*[F.lit(p[k]) for p in path]), F.col("id").cast("int")).alias("ab"[k]) for k in (0, 1)], F.lit(products).cast("long").alias("products"))


# From the right: 12 * 30 * 3 + 7 * 12 * 3 + suppliers * 7 * 3 products, and no order needs fewer.
_add("einsum_path_of_four", "lineitem", _path, "SELECT step::BIGINT AS step, a::INTEGER AS a, b::INTEGER AS b, 1080 + 252 + 21 * (SELECT max(l_suppkey % 40) + 1 FROM lineitem)::BIGINT AS products FROM (VALUES (0, 2, 3), (1, 1, 2), (2, 0, 1)) t(step, a, b)")
_CUBE = "(SELECT l_suppkey % 40 AS i, l_linenumber - 1 AS j, month(l_shipdate) - 1 AS k, sum(l_quantity) AS x FROM lineitem GROUP BY ALL)"
_cube = lambda f: (f.selectExpr("l_suppkey % 40 AS i", "l_linenumber - 1 AS j", "month(l_shipdate) - 1 AS k", "l_quantity").groupBy("i", "j", "k").agg(F.sum("l_quantity").alias("x")), ["i", "j", "k"], "x")
_longs = lambda frame: frame.select(*[F.col(c).cast("long").alias(c) for c in frame.columns if c != "x"], F.round("x", 3).alias("x"))
_add("tensordot_two_axes", "lineitem", lambda f: _longs(tensor.tensordot(_cube(f), _cube(f), ([1, 2], [1, 2]))), f"SELECT a.i::BIGINT AS d0, b.i::BIGINT AS d1, sum(a.x * b.x) AS x FROM {_CUBE} a JOIN {_CUBE} b USING (j, k) GROUP BY ALL")
_add("tensordot_last_and_first", "lineitem", lambda f: _longs(tensor.tensordot(_cube(f), (lambda t: (t[0], ["k", "l"], "x"))((_pair(f, "kl")[0].toDF("k", "l", "x"), 0, 0)), 1)),
     f"SELECT i::BIGINT AS d0, j::BIGINT AS d1, l::BIGINT AS d2, round(sum(a.x * b.x), 3) AS x FROM {_CUBE} a JOIN {_pair_sql('kl')} b USING (k) GROUP BY ALL")
_add("einsum_ellipsis", "lineitem", lambda f: (lambda t: _longs(t.select(F.col("A").alias("d0"), F.col("B").alias("d1"), F.col("l").alias("d2"), "x")))(tensor.einsum("...k,kl->...l", _cube(f), (_pair(f, "kl")[0], ["a", "b"], "x"))),
     f"SELECT i::BIGINT AS d0, j::BIGINT AS d1, l::BIGINT AS d2, round(sum(a.x * b.x), 3) AS x FROM {_CUBE} a JOIN {_pair_sql('kl')} b USING (k) GROUP BY ALL")

# Least squares over all line items: prices as a polynomial's places, of degree 12, and its values without error.
_COEFFICIENTS = [((-1) ** k * (k + 1)) / 4 for k in range(13)]


def _polynomial(lines):
    place = F.col("l_extendedprice") / 105000
    powers = F.array(*[F.pow(place, F.lit(k)) for k in range(13)])
    value = F.aggregate(F.array(*[F.lit(c) for c in reversed(_COEFFICIENTS)]), F.lit(0.0), lambda total, c: total * place + c)
    found = blocks.least_squares(lines.select(powers.alias("v"), value.alias("y")), "v", "y")
    places = F.get(F.array(*[F.lit(round(float(c), 4)) for c in found[0]]), F.col("id").cast("int"))
    return lines.sparkSession.range(13).select(F.col("id").alias("k"), places.alias("c"), F.lit(found[2]).cast("long").alias("rank"))


_add("least_squares_tall", "lineitem", _polynomial, "SELECT k::BIGINT AS k, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * (k + 1) / 4e0 AS c, 13::BIGINT AS rank FROM range(13) t(k)")


def _line(lines):
    found = blocks.least_squares(lines.select(F.array(F.lit(1.0), F.col("l_quantity")).alias("v"), F.col("l_extendedprice").alias("y")), "v", "y")
    return lines.sparkSession.range(1).select(*[F.lit(round(float(v), d)).alias(n) for v, n, d in ((found[0][0], "intercept", 3), (found[0][1], "slope", 4))], F.lit(round(found[1] / 1e6, 2)).alias("residual"))


_add("least_squares_line", "lineitem", _line, "SELECT round(regr_intercept(y, x), 3) AS intercept, round(regr_slope(y, x), 4) AS slope, round((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / 1e6, 2) AS residual FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem)")


def _triangle(embeddings):
    r = blocks.tall_r(embeddings, "embedding")
    cells = [(i, j, float(r[i, j])) for i in range(64) for j in range(64) if r[i, j]]
    frame = embeddings.sparkSession.createDataFrame(cells, "i long, j long, x double").filter("j >= i AND (i < j OR x > 0)")
    return _rounded(tensor.einsum("ki,kj->ij", (frame, ["i", "j"], "x"), (frame, ["i", "j"], "x")))


# R is a triangle with a positive diagonal whose product with its transpose is that of the rows: the only one.
_add("qr_triangle_tall", "embeddings", _triangle, f"SELECT i, j, round(x, 3) + 0.0 AS x FROM {_GRAM}")


def _orthogonal(embeddings):
    q = blocks.tall_q(embeddings.select("vec_id", "embedding"), "embedding", blocks.tall_r(embeddings, "embedding"))
    cells = q.select("vec_id", F.posexplode("q").alias("i", "x"))
    return _rounded(tensor.einsum("vi,vj->ij", (cells, ["vec_id", "i"], "x"), (cells, ["vec_id", "i"], "x")), 8)


_add("qr_orthogonal_tall", "embeddings", _orthogonal, "SELECT i.range AS i, j.range AS j, (i.range = j.range)::INTEGER::DOUBLE AS x FROM range(64) i, range(64) j")
