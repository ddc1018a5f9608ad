"""Query op9: documents without repeated 50-word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridock.llm import substrings


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; null texts have no words."""
    return substrings.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos : pos + 49], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM docs WHERE len(words) >= 50)
), firsts AS (
  SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM windows JOIN firsts USING (w) WHERE first_doc < doc_id
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS left_text, count(*) AS n_kept FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""
