"""All registered queries of the engine's own operators, with the SQL that states each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import axes, blocks, checks, elementwise, elimination, fourier, frames, indexing, makers, masked_math, orders, quadrature, random, raw, scans, series, shapes, spectra, text, vectors

MODULES = (axes, blocks, checks, elementwise, elimination, fourier, frames, indexing, makers, masked_math, orders, quadrature, random, raw, scans, series, shapes, spectra, text, vectors)


def entry(spark: SparkSession) -> DataFrame:
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    price = F.col("l_extendedprice")
    return (
        items.filter(F.col("l_discount") > 0.05)
        .groupBy("l_returnflag")
        .agg(
            F.round(F.sum(price), 4).alias("total"),
            F.round(F.avg(price), 4).alias("mean"),
            F.round(F.var_pop(price), 2).alias("variance"),
            F.max(price).alias("top"),
        )
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
