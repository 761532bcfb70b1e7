"""The registered query of language identification; SQL can't state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.langid import fit_profiles, predict_languages
from tessera.llm.shared import id_remainder, table


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder(F.col("doc_id")) == 1)
    profiles = fit_profiles(docs.filter("not held_out"))
    return predict_languages(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
