"""The registered query of media columns; SQL can't state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.media import media_features, read_media, write_media
from tessera.llm.shared import forget_at_exit, shared_dir, table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_media(table(spark, sf_dir, "documents"), path)
    forget_at_exit(spark, path)
    return media_features(read_media(spark, path))
