"""Queries that write line items as raw arrays and read them back, and of bytes in columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.window import with_positions
from tessera.session import scratch_path
from tessera.sources import raw

QUERIES, ORACLES = {}, {}

_PLACED = "(SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) - 1 AS pos FROM lineitem)"


def _add(name, run, sql):
    QUERIES[name] = lambda spark, sf_dir: run(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    ORACLES[name] = sql


def _through(value, dtype, **options):
    def run(spark, table):
        path = scratch_path(spark)
        items = with_positions(table("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"])
        raw.tofile(items.select("pos", F.expr(value).alias("value")), path, dtype)
        return raw.fromfile(spark, path, range_bytes=1 << 16, **options)

    return run


_BIG = "9007199254740993 + l_orderkey * 7 + l_linenumber"
_add("tofile_fromfile_int64", _through(_BIG, "<i8"), f"SELECT pos, {_BIG} AS value FROM {_PLACED}")
_add("tofile_fromfile_int16", _through("l_partkey % 30000 - 15000", "<i2"), f"SELECT pos, (l_partkey % 30000 - 15000)::BIGINT AS value FROM {_PLACED}")
_add("tofile_fromfile_float64", _through("l_extendedprice / 3", "<f8"), f"SELECT pos, l_extendedprice / 3 AS value FROM {_PLACED}")
_add("tofile_fromfile_bool", _through("l_quantity > 25", "|b1"), f"SELECT pos, l_quantity > 25 AS value FROM {_PLACED}")
_complex = _through("named_struct('re', l_quantity, 'im', -l_discount)", "<c16")
_add("tofile_fromfile_complex", lambda s, t: _complex(s, t).select("pos", "value.*"), f"SELECT pos, l_quantity AS re, -l_discount AS im FROM {_PLACED}")
_add("fromfile_count", _through("l_orderkey", "<i8", count=1000), f"SELECT pos, l_orderkey AS value FROM {_PLACED} WHERE pos < 1000")
_add("tobytes", lambda s, t: t("embeddings").select("vec_id", F.lower(F.hex(raw.tobytes(F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")).cast("long")), "<i2"))).alias("y")),
     "SELECT vec_id, array_to_string([format('{:04x}', ((v % 256) * 256 + v // 256)) FOR v IN [((floor(x * 100)::BIGINT % 65536) + 65536) % 65536 FOR x IN embedding]], '') AS y FROM embeddings")
_add("frombuffer", lambda s, t: t("part").select("p_partkey", raw.frombuffer(F.unhex(F.md5("p_name")), "<u2", offset=4, count=5).alias("v")).select("p_partkey", F.posexplode("v").alias("k", "y")),
     "SELECT p_partkey, k::INTEGER AS k, ('0x' || substr(h, 4 * k + 11, 2) || substr(h, 4 * k + 9, 2))::BIGINT AS y FROM (SELECT p_partkey, md5(p_name) AS h FROM part), range(5) r(k)")
