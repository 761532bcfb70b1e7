"""The registered query of licence detection. SQL that DuckDB runs can't state its sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.licenses import license_columns, scan_licenses
from tessera.llm.shared import table

COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_columns(scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))).select(*COLUMNS)
