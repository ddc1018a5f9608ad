"""Query op2: documents interleaved to target weights of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridock.llm import mixing

WEIGHTS = {"src0": 6, "src1": 4, "src2": 3, "src3": 2}
BLOCK_ROWS = 64


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, block, slot, place) of every document, null sources as the empty one."""
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS, 1, BLOCK_ROWS)


_W = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items()) + " ELSE 1 END"
ORACLE = f"""
WITH RECURSIVE named AS (
  SELECT coalesce(source, '') AS source FROM documents
), shares AS (
  SELECT list(source ORDER BY source) AS names, list(CAST({_W} AS BIGINT) ORDER BY source) AS w FROM (SELECT DISTINCT source FROM named)
), sized AS (
  SELECT names, w, CAST(list_sum(w) AS BIGINT) AS q, range(1, len(w) + 1) AS ks FROM shares
), schedule AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS k, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done FROM sized
  UNION ALL
  SELECT t + 1, best, list_transform(ks, lambda j: CASE WHEN j = best THEN done[j] + 1 ELSE done[j] END)
  FROM (
    SELECT s.t, s.done, z.ks, list_min(list_transform(list_filter(z.ks, lambda j: s.done[j] < z.w[j] AND (s.done[j] * z.q) // z.w[j] <= s.t + 1),
      lambda j: ((s.done[j] + 1) * z.q + z.w[j] - 1) // z.w[j] * 1000000 + j)) % 1000000 AS best
    FROM schedule s, sized z WHERE s.t + 1 < z.q
  )
), turns AS (
  SELECT names[k] AS source, done[k] - 1 AS turn, t AS first_slot, w[k] AS weight, q FROM schedule, sized WHERE t >= 0
), numbered AS (
  SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id NULLS FIRST) - 1 AS n FROM documents
)
SELECT doc_id, source, CAST(n // {BLOCK_ROWS} AS BIGINT) AS block, CAST((n // {BLOCK_ROWS}) // weight * q + first_slot AS BIGINT) AS slot, CAST(n % {BLOCK_ROWS} AS BIGINT) AS place
FROM numbered JOIN turns USING (source) WHERE (n // {BLOCK_ROWS}) % weight = turn
"""
