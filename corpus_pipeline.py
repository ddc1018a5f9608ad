"""The corpus pipeline: five stages from raw documents to a training mix.

Each stage takes all rows that the one before kept, and is written as Parquet
and read again before the next; the table before is then deleted.  All but the
last return the columns of ``documents``; the last adds each row's place in the
mix (read by ``mix_slot``, then ``mix_place``).  Extra columns of any name are
kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm import decontam, mixing, neardup, op2, op4, quality, substrings
from veridock.llm.samples import remainder
from veridock.llm.scratch import materialise, release


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.  Each row is judged by its text alone,
    repeated rows and null ids like any other; null and empty texts by the bias."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("id", 4) != 2)
    return quality.keep_good(docs, model, op4.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.
    Of rows that repeat an id and a text one stays; null ids and texts without
    words stay."""
    return neardup.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows that start in an earlier document; ``n_chars``
    follows the text.  Rows with a null id and null texts stay as they are; rows
    that repeat an id aren't copies of each other."""
    out = substrings.without_repeats(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts stay, each row is
    judged alone."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix of sources; null sources are one
    source, and each of repeated rows has a place of its own."""
    return mixing.mixed_documents(docs, op2.WEIGHTS, 1, op2.BLOCK_ROWS)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The classifier and the sketches can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
