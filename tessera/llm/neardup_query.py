"""The registered query of near-duplicate detection; its parameters are stated by the query's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.neardup import MinHash, near_duplicates
from tessera.llm.shared import table

SPEC = MinHash(width=3, percent=85, rows=6)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), SPEC).select("doc_id", "n_shingles", "component_id", "kept")
