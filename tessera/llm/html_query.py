"""The registered query of main text extraction; SQL can't state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.html import extract_pages
from tessera.llm.shared import table


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
