"""Query op3: tokens of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm import tokencount

LIMIT = 1024


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; null texts are empty."""
    counted = tokencount.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
