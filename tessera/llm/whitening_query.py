"""The registered query of embedding whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import table
from tessera.llm.whitening import whiten


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
