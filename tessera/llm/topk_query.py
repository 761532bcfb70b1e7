"""The registered query of exact top-k search and the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import table
from tessera.llm.topk import top_k


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.x, d.x)])::BIGINT AS score
  FROM usable q JOIN usable d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
