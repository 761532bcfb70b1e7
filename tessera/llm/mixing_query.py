"""The registered query of source mixing and the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.mixing import SEED, mix_plan
from tessera.llm.shared import table


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, chr(0)), coalesce(source, chr(0)), coalesce(text, chr(0)))) AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         (source_size * 3)::DOUBLE AS cap FROM totals),
levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ranked
  WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
budgets AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
"""
