"""Query op8: benchmark passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridock.llm import decontam


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): the best window of each document and item at 0.6 or more."""
    return decontam.contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
