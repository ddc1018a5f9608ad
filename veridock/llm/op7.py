"""Query op7: language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm import langid
from veridock.llm.samples import remainder


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    model = langid.fit(docs, remainder("id", 3) != 1)
    return langid.identify(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; ``und`` for texts without letters."""
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
