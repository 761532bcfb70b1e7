"""The registered query of toxicity; SQL can't state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.langid import fit_profiles
from tessera.llm.shared import id_remainder, table
from tessera.llm.toxicity import fit_toxicity, score_toxicity


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id")) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out)
    learning = docs.filter("not held_out")
    profiles = fit_profiles(learning)
    net = fit_toxicity(learning, table(spark, sf_dir, "labels").filter(~held_out), profiles)
    return score_toxicity(docs.select("doc_id", "held_out", "text"), net, profiles).select("doc_id", "held_out", "score", "predicted")
