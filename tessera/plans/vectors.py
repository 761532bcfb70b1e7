"""Queries of methods, complex numbers, row kernels and dense kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import complexes as C
from tessera.functions import dense, methods, rows

QUERIES, ORACLES = {}, {}


def _add(name, table, run, sql=None):
    QUERIES[name] = lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{table}.parquet"), lambda other: spark.read.parquet(f"{sf_dir}/{other}.parquet"))
    if sql:
        ORACLES[name] = sql


for _name, _sql in {"add": "sum", "multiply": "product", "maximum": "max", "minimum": "min", "bitwise_and": "bit_and", "bitwise_or": "bit_or", "bitwise_xor": "bit_xor"}.items():
    _v = "CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END" if _name == "multiply" else "p_size"
    for _as in (f"ufunc_reduce_{_name}", f"ufunc_reduce_{_name}_all"):
        _add(_as, "part", lambda f, _, n=_name, v=_v: methods.ufunc_reduce(f.withColumn("x", F.expr(v)), n, "x", ["p_brand"]), f"SELECT p_brand, {_sql}({_v}) AS y FROM part GROUP BY p_brand")
for _name, _sql in {"add": "sum", "maximum": "max", "minimum": "min"}.items():
    _add(f"ufunc_accumulate_{_name}", "part", lambda f, _, n=_name: methods.ufunc_accumulate(f, n, "p_size", ["p_partkey"], ["p_brand"]).select("p_partkey", "y"), f"SELECT p_partkey, {_sql}(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS y FROM part")
_add("ufunc_outer_greater", "nation", lambda f, t: methods.ufunc_outer(f.select(F.col("n_nationkey").alias("a")), t("region").select(F.col("r_regionkey").alias("b")), "greater", "a", "b"), "SELECT n_nationkey AS a, r_regionkey AS b, n_nationkey > r_regionkey AS z FROM nation, region")
_add("ufunc_at_add", "nation", lambda f, t: methods.ufunc_at(f.select("n_nationkey", F.lit(0).cast("bigint").alias("n")), "add", "n_nationkey", "n", t("customer").withColumn("one", F.lit(1)), "c_nationkey", "one"), "SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
_add("ufunc_reduceat_add", "part", lambda f, _: methods.ufunc_reduceat(f, "add", "p_partkey", "p_size", [0, 20, 50, 150]), "SELECT ((p_partkey >= 20)::INT + (p_partkey >= 50)::INT + (p_partkey >= 150)::INT)::INTEGER AS segment, sum(p_size) AS y FROM part WHERE p_partkey >= 0 GROUP BY 1")

_Z = lambda: C.make(F.col("p_size") - 20, F.col("p_partkey") % 9 - 4)
_W = lambda: C.make(F.col("p_size") % 5 + 1, F.col("p_partkey") % 7 - 3)
_CTE = "WITH z AS (SELECT p_partkey, (p_size - 20)::DOUBLE AS a, (p_partkey % 9 - 4)::DOUBLE AS b, (p_size % 5 + 1)::DOUBLE AS c, (p_partkey % 7 - 3)::DOUBLE AS d FROM part) "
_pair = lambda z: [F.round(z["re"] + 0.0, 6).alias("re"), F.round(z["im"] + 0.0, 6).alias("im")]
_add("complex_multiply", "part", lambda f, _: f.select("p_partkey", C.multiply(_Z(), _W()).alias("z")).select("p_partkey", *_pair(F.col("z"))), _CTE + "SELECT p_partkey, round(a * c - b * d, 6) AS re, round(a * d + b * c, 6) AS im FROM z")
_add("complex_add", "part", lambda f, _: f.select("p_partkey", C.add(_Z(), C.conj(_W())).alias("z")).select("p_partkey", *_pair(F.col("z"))), _CTE + "SELECT p_partkey, round(a + c, 6) AS re, round(b - d, 6) AS im FROM z")
_add("complex_divide", "part", lambda f, _: f.select("p_partkey", C.divide(_Z(), _W()).alias("z")).select("p_partkey", *[(c + 0.0).alias(n) for c, n in zip(_pair(F.col("z")), ("re", "im"))]), _CTE + "SELECT p_partkey, round((a * c + b * d) / (c * c + d * d), 6) + 0.0 AS re, round((b * c - a * d) / (c * c + d * d), 6) + 0.0 AS im FROM z")
_add("complex_absolute_angle", "part", lambda f, _: f.select("p_partkey", F.round(C.absolute(_W()), 6).alias("r"), F.round(C.angle(_W()), 6).alias("phi")), _CTE + "SELECT p_partkey, round(sqrt(c * c + d * d), 6) AS r, round(atan2(d, c), 6) AS phi FROM z")

_E = "(SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)"
_add("rows_norm", "embeddings", lambda f, _: f.select("vec_id", F.round(rows.norm(F.col("embedding"), 1), 5).alias("y")), f"SELECT vec_id, round(list_sum([abs(x) FOR x IN v]), 5) AS y FROM {_E}")
_add("rows_norm_inf", "embeddings", lambda f, _: f.select("vec_id", F.round(rows.norm(F.col("embedding"), float("inf")), 7).alias("y")), f"SELECT vec_id, round(list_max([abs(x) FOR x IN v]), 7) AS y FROM {_E}")
_add("rows_logsumexp", "embeddings", lambda f, _: f.select("vec_id", F.round(rows.row_logsumexp(F.col("embedding")), 6).alias("y")), f"SELECT vec_id, round(ln(list_sum([exp(x) FOR x IN v])), 6) AS y FROM {_E}")
_add("rows_argmax", "embeddings", lambda f, _: f.select("vec_id", rows.argmax(F.col("embedding")).alias("y")), "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS y FROM embeddings")
_add("rows_scatter_add", "embeddings", lambda f, _: rows.scatter_add(f, "label", "embedding").select("label", F.posexplode("v").alias("j", "x")).withColumn("x", F.round("x", 5) + 0.0), "SELECT label, j, round(sum(x), 5) + 0.0 AS x FROM (SELECT label, unnest(range(len(embedding)))::INTEGER AS j, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, j")
_add("rows_gather", "embeddings", lambda f, t: rows.gather(f, "vec_id", t("part").select("p_partkey", (F.col("p_partkey") % 100).alias("i")), "i").select("p_partkey", "label"), "SELECT p_partkey, label FROM part JOIN embeddings ON vec_id = p_partkey % 100")
_add("binary_repr", "part", lambda f, _: f.select("p_partkey", rows.binary_repr(F.col("p_size") - 30, 8).alias("y")), "SELECT p_partkey, right(((p_size - 30)::BIGINT + 256)::BIGINT::BIT::VARCHAR, 8) AS y FROM part")
_add("base_repr", "part", lambda f, _: f.select("p_partkey", rows.base_repr(F.col("p_partkey"), 16).alias("y")), "SELECT p_partkey, upper(to_hex(p_partkey)) AS y FROM part")
_add("packbits", "part", lambda f, _: f.select("p_partkey", F.element_at(rows.packbits(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.floor(F.col("p_size") / F.pow(F.lit(2.0), 7 - k)) % 2).cast("int"))), 1).alias("y")), "SELECT p_partkey, p_size AS y FROM part")
for _as in ("rows_sliding", "rows_sliding_all"):
    _add(_as, "embeddings", lambda f, _: f.select("vec_id", F.posexplode(rows.sliding_window_view(F.col("embedding"), 3)).alias("j", "w")).select("vec_id", "j", F.round(rows.dot(F.col("w"), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))), 5).alias("y")), "SELECT vec_id, j, round(embedding[j + 1]::DOUBLE + embedding[j + 2]::DOUBLE + embedding[j + 3]::DOUBLE, 5) AS y FROM (SELECT vec_id, embedding, unnest(range(len(embedding) - 2))::INTEGER AS j FROM embeddings)")

_ABCD = lambda f: f.select("p_partkey", F.array(F.col("p_size") + 60.0, F.col("p_partkey") % 7 + 0.0, F.col("p_partkey") % 7 + 0.0, F.col("p_partkey") % 11 + 20.0).alias("m"))
_M = "(SELECT p_partkey, p_size + 60e0 AS a, p_partkey % 7 + 0e0 AS b, p_partkey % 11 + 20e0 AS d FROM part)"
_add("linalg_det", "part", lambda f, _: dense.kernel(_ABCD(f), "det", "m").select("p_partkey", F.round("y", 5).alias("y")), f"SELECT p_partkey, round(a * d - b * b, 5) AS y FROM {_M}")
_add("linalg_inv", "part", lambda f, _: dense.kernel(_ABCD(f), "inv", "m").select("p_partkey", F.posexplode("y").alias("j", "y")).withColumn("y", F.round("y", 9) + 0.0), f"SELECT p_partkey, k.range::INTEGER AS j, round([d, -b, -b, a][k.range + 1] / (a * d - b * b), 9) + 0.0 AS y FROM {_M}, range(4) k")
_add("linalg_eigvalsh", "part", lambda f, _: dense.kernel(_ABCD(f), "eigvalsh", "m").select("p_partkey", F.posexplode("y").alias("j", "y")).withColumn("y", F.round("y", 6)), f"SELECT p_partkey, k.range::INTEGER AS j, round((a + d) / 2 + (2 * k.range - 1) * sqrt((a - d) * (a - d) / 4 + b * b), 6) AS y FROM {_M}, range(2) k")
_add("linalg_cholesky", "part", lambda f, _: dense.kernel(_ABCD(f), "cholesky", "m").select("p_partkey", F.posexplode("y").alias("j", "y")).withColumn("y", F.round("y", 6)), f"SELECT p_partkey, k.range::INTEGER AS j, round([sqrt(a), 0, b / sqrt(a), sqrt(d - b * b / a)][k.range + 1], 6) AS y FROM {_M}, range(4) k")
_add("fft_power_spectrum", "embeddings", lambda f, _: dense.kernel(f.select("vec_id", "embedding"), "power_spectrum", "embedding").select("vec_id", F.posexplode("y").alias("k", "y")).withColumn("y", F.round("y", 5)),
     "WITH c AS (SELECT vec_id, unnest(range(64)) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, k.range::INTEGER AS k, round(pow(sum(x * cos(2 * pi() * k.range * n / 64)), 2) + pow(sum(x * sin(2 * pi() * k.range * n / 64)), 2), 5) AS y FROM c, range(33) k GROUP BY vec_id, k.range")
for _name in ("fft", "svdvals", "cond", "matrix_rank", "eigvals", "pinv"):
    _add(f"dense_{_name}", "embeddings", lambda f, _, n=_name: dense.kernel(f.select("vec_id", "embedding"), n, "embedding").select("vec_id", "y"))
for _name, _args in {"normal": (0.0, 1.0), "random": (), "exponential": (2.0,), "poisson": (3.0,), "gamma": (2.0, 1.0)}.items():
    _add(f"random_{_name}", "customer", lambda f, _, n=_name, a=_args: dense.random_rows(f.select("c_custkey"), "c_custkey", n, 42, *a))
