"""Query op1: the ten nearest sign codes of every hundredth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm import topk

K = 10


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, distance): the ten rows nearest to each queried one,
    in Hamming distance of signs, ties by id; null ids and empty vectors are left out."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), K)


ORACLE = f"""
WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST((q.embedding[i] > 0) <> (v.embedding[i] > 0) AS INTEGER))) AS BIGINT) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0
)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM pairs) WHERE rank <= {K}
"""
