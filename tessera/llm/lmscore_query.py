"""The registered query of language-model scores; SQL can't state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.lmscore import fit_model, score_documents
from tessera.llm.shared import table


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, fit_model(docs), keep=["doc_id"])
