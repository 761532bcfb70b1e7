"""Queries of indexing, assignment and broadcasting over a tensor of line items: supplier (modulo 40), line number, month."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import indexing as ix
from tessera.operators.indexing import Tensor, constant

QUERIES, ORACLES = {}, {}

SHAPE = (40, 7, 12)
_T = "(SELECT l_suppkey % 40 AS i, l_linenumber - 1 AS j, month(l_shipdate) - 1 AS k, sum(l_quantity) AS x FROM lineitem GROUP BY ALL)"
_M = "(SELECT l_suppkey % 40 AS i, l_linenumber - 1 AS j, sum(l_discount) AS x FROM lineitem GROUP BY ALL)"
_V = "(SELECT month(l_shipdate) - 1 AS k, count(*)::DOUBLE AS x FROM lineitem GROUP BY ALL)"
_SUPPLIER, _LINE, _MONTH = "l_suppkey % 40 AS i", "l_linenumber - 1 AS j", "month(l_shipdate) - 1 AS k"


def cube(lines) -> Tensor:
    return Tensor(lines.selectExpr(_SUPPLIER, _LINE, _MONTH, "l_quantity").groupBy("i", "j", "k").agg(F.sum("l_quantity").alias("x")), SHAPE, ("i", "j", "k"))


def matrix(lines) -> Tensor:
    return Tensor(lines.selectExpr(_SUPPLIER, _LINE, "l_discount").groupBy("i", "j").agg(F.sum("l_discount").alias("x")), SHAPE[:2], ("i", "j"))


def months(lines) -> Tensor:
    return Tensor(lines.selectExpr(_MONTH).groupBy("k").agg(F.count("*").cast("double").alias("x")), SHAPE[2:], ("k",))


def _add(name, run, sql):
    """``run`` gets the line items; the SQL names its columns d0, d1, ... and x as the tensor's own."""

    def query(spark, sf_dir):
        made = run(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
        frame = made.frame if isinstance(made, Tensor) else made
        return frame.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) for c, kind in frame.dtypes])

    QUERIES[name], ORACLES[name] = query, sql.replace("CUBE", _T + " t").replace("MATRIX", _M + " m").replace("MONTHS", _V + " v")


def _cells(places: str, where: str = "true", x: str = "x", of: str = "CUBE") -> str:
    columns = ", ".join(f"({p})::BIGINT AS d{n}" for n, p in enumerate(p for p in places.split(";") if p))
    return f"SELECT {columns + ', ' if columns else ''}round({x}, 6) AS x FROM {of} WHERE {where}"


# Reading.
_add("index_element", lambda f: cube(f)[3, 2, -1], _cells("", "i = 3 AND j = 2 AND k = 11"))
_add("index_sub_array", lambda f: cube(f)[5], _cells("j;k", "i = 5"))
_add("index_slices", lambda f: cube(f)[2:31:3, :, slice(None, None, -2)], _cells("(i - 2) // 3;j;(11 - k) // 2", "i BETWEEN 2 AND 30 AND i % 3 = 2 AND k % 2 = 1"))
_add("index_ellipsis", lambda f: cube(f)[..., 4], _cells("i;j", "k = 4"))
_add("index_new_axes", lambda f: cube(f)[:, None, 1, ..., None], _cells("i;0;k;0", "j = 1"))
_add("index_integers", lambda f: cube(f)[[3, -1, 3]], _cells("p;j;k", of="CUBE JOIN (VALUES (0, 3), (1, 39), (2, 3)) a(p, q) ON i = q"))
_add("index_adjacent_arrays", lambda f: cube(f)[:, [0, 2, 6], [1, 3, 11]], _cells("i;p", of="CUBE JOIN (VALUES (0, 0, 1), (1, 2, 3), (2, 6, 11)) a(p, q, r) ON j = q AND k = r"))
_add("index_apart_arrays", lambda f: cube(f)[[0, 1], :, [4, 5]], _cells("p;j", of="CUBE JOIN (VALUES (0, 0, 4), (1, 1, 5)) a(p, q, r) ON i = q AND k = r"))
_add("index_integer_apart_from_array", lambda f: cube(f)[0, 1:6:2, [0, 11]], _cells("p;(j - 1) // 2", "i = 0 AND j IN (1, 3, 5)", of="CUBE JOIN (VALUES (0, 0), (1, 11)) a(p, r) ON k = r"))
_add(
    "index_broadcast_arrays",
    lambda f: cube(f)[[[1], [7], [-2]], :, [2, 3]],
    _cells("p;s;j", of="CUBE JOIN (VALUES (0, 1), (1, 7), (2, 38)) a(p, q) ON i = q JOIN (VALUES (0, 2), (1, 3)) b(s, r) ON k = r"),
)
_add("index_rows_of_mask", lambda f: cube(f)[[j % 3 == 0 for j in range(40)]], _cells("i // 3;j;k", "i % 3 = 0"))
_add("index_mask", lambda f: (lambda t: t[t.map(lambda x: x % 5 == 0)])(cube(f)), "SELECT (row_number() OVER (ORDER BY i, j, k) - 1)::BIGINT AS d0, x FROM CUBE WHERE x % 5 = 0")
_add(
    "index_mask_of_two_axes",
    lambda f: (lambda t, m: t[m.map(lambda x: x > 1), 1:3])(cube(f), matrix(f)),
    f"SELECT b.p::BIGINT AS d0, (k - 1)::BIGINT AS d1, t.x FROM CUBE JOIN (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS p FROM {_M} WHERE x > 1) b USING (i, j) WHERE k IN (1, 2)",
)
_add(
    "index_by_tensor",
    lambda f: (lambda t, v: t[:, :, v.map(lambda x: x.cast("long") % 12)])(cube(f), months(f)),
    f"SELECT i::BIGINT AS d0, j::BIGINT AS d1, v.k::BIGINT AS d2, t.x FROM CUBE JOIN {_V} v ON t.k = v.x::BIGINT % 12",
)
_add("index_concatenate", lambda f: (lambda t: ix.concatenate(t[:2, 0], months(f)[None], t[7, 1:3]))(cube(f)),
     "SELECT i::BIGINT AS d0, k::BIGINT AS d1, x FROM CUBE WHERE i < 2 AND j = 0 UNION ALL SELECT 2, k::BIGINT, x FROM MONTHS UNION ALL SELECT 2 + j, k::BIGINT, x FROM CUBE WHERE i = 7 AND j IN (1, 2)")

# Writing.
_WHOLE = "i;j;k"
_add("assign_number", lambda f: ix.put(cube(f), (slice(None), 1), 1.5), _cells(_WHOLE, x="CASE WHEN j = 1 THEN 1.5 ELSE x END"))
_add("assign_slice", lambda f: ix.put(cube(f), (slice(30, 4, -5), Ellipsis, slice(2, None, 4)), F.col("x") * -2), _cells(_WHOLE, x="CASE WHEN i BETWEEN 5 AND 30 AND i % 5 = 0 AND k IN (2, 6, 10) THEN -2 * x ELSE x END"))
_add("assign_mask", lambda f: (lambda t: ix.put(t, t.map(lambda x: x > 60), 0.0))(cube(f)), _cells(_WHOLE, x="CASE WHEN x > 60 THEN 0 ELSE x END"))
_add("assign_vector", lambda f: ix.put(cube(f), (4,), months(f)), f"SELECT t.i::BIGINT AS d0, t.j::BIGINT AS d1, t.k::BIGINT AS d2, CASE WHEN t.i = 4 THEN coalesce(v.x, t.x) ELSE t.x END AS x FROM CUBE LEFT JOIN {_V} v USING (k)")
_add(
    "assign_by_arrays_last_wins",
    lambda f: ix.put(cube(f), ([0, 2, 0], slice(None), [1, 1, 1]), constant(f.sparkSession, [[10.0], [20.0], [30.0]])),
    _cells(_WHOLE, x="CASE WHEN i = 0 AND k = 1 THEN 30 WHEN i = 2 AND k = 1 THEN 20 ELSE x END"),
)
_add(
    "assign_column_of_matrix",
    lambda f: ix.put(cube(f), (Ellipsis, slice(0, 3)), matrix(f)[:, :, None]),
    f"SELECT t.i::BIGINT AS d0, t.j::BIGINT AS d1, t.k::BIGINT AS d2, round(CASE WHEN k < 3 THEN coalesce(m.x, t.x) ELSE t.x END, 6) AS x FROM CUBE LEFT JOIN {_M} m USING (i, j)",
)
_add("assign_all", lambda f: ix.put(cube(f), Ellipsis, months(f)), f"SELECT t.i::BIGINT AS d0, t.j::BIGINT AS d1, t.k::BIGINT AS d2, coalesce(v.x, t.x) AS x FROM CUBE LEFT JOIN {_V} v USING (k)")

# Broadcasting.
_add("broadcast_vector_to_tensor", lambda f: ix.broadcast_to(months(f), SHAPE), "SELECT a.range AS d0, b.range AS d1, k::BIGINT AS d2, x FROM MONTHS, range(40) a, range(7) b")
_add("broadcast_column_to_tensor", lambda f: ix.broadcast_to(matrix(f)[:, :, None], SHAPE), "SELECT i::BIGINT AS d0, j::BIGINT AS d1, c.range AS d2, round(x, 6) AS x FROM MATRIX, range(12) c")
_PAIR = f"FROM CUBE JOIN {_V} v USING (k)"
_add("broadcast_add", lambda f: ix.apply(lambda x, y: x + y, cube(f), months(f)), f"SELECT i::BIGINT AS d0, j::BIGINT AS d1, k::BIGINT AS d2, t.x + v.x AS x {_PAIR}")
_add("broadcast_by_inner_axis", lambda f: ix.apply(lambda x, y: x * y, cube(f), matrix(f)[:, :, None]), f"SELECT i::BIGINT AS d0, j::BIGINT AS d1, k::BIGINT AS d2, round(t.x * m.x, 6) AS x FROM CUBE JOIN {_M} m USING (i, j)")
_add("broadcast_both_ways", lambda f: ix.apply(lambda x, y: x - y, cube(f)[:, 0, None, :], matrix(f)[:, :, None]),
     f"SELECT i::BIGINT AS d0, m.j::BIGINT AS d1, k::BIGINT AS d2, round(t.x - m.x, 6) AS x FROM CUBE JOIN {_M} m USING (i) WHERE t.j = 0")
_add("broadcast_three", lambda f: ix.broadcast(cube(f), months(f), matrix(f)[:, :, None])[0],
     f"SELECT i::BIGINT AS d0, j::BIGINT AS d1, k::BIGINT AS d2, t.x AS x0, v.x AS x1, round(m.x, 6) AS x2 FROM CUBE JOIN {_V} v USING (k) JOIN {_M} m USING (i, j)")
_add("broadcast_arrays", lambda f: (lambda a, b: a.frame.join(b.frame.withColumnRenamed("x", "y"), ["d0", "d1"]))(*ix.broadcast_arrays(matrix(f)[:, 2:3], matrix(f)[3:4])),
     f"SELECT m.i::BIGINT AS d0, n.j::BIGINT AS d1, round(m.x, 6) AS x, round(n.x, 6) AS y FROM MATRIX, {_M} n WHERE m.j = 2 AND n.i = 3")
_add("broadcast_iterate", lambda f: ix.iterate(cube(f), months(f)), f"SELECT (row_number() OVER (ORDER BY i, j, k) - 1)::BIGINT AS pos, t.x AS x0, v.x AS x1 {_PAIR}")
_add("broadcast_compare", lambda f: ix.apply(lambda x, y: (x > y).cast("long"), cube(f), cube(f)[:, :, 5:6]), f"SELECT i::BIGINT AS d0, j::BIGINT AS d1, t.k::BIGINT AS d2, (t.x > u.x)::BIGINT AS x FROM CUBE JOIN (SELECT i, j, x FROM {_T} WHERE k = 5) u USING (i, j)")
_add("broadcast_outer", lambda f: ix.outer(lambda x, y: x * y, months(f), matrix(f)[:, 3]), "SELECT k::BIGINT AS d0, i::BIGINT AS d1, round(v.x * m.x, 6) AS x FROM MONTHS, MATRIX WHERE j = 3")
