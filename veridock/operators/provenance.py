"""Every assertion back to its exact place in a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify_spans(claims: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(claim_id, source_id, verdict) for every claim.

    ``missing_source``, ``invalid_span``, ``excerpt_mismatch``,
    ``checksum_mismatch`` or ``ok``.  Each document is joined once, by id; a
    claim without a source stays, as an error.
    """
    texts = docs.select(F.col(id_col).alias("source_id"), F.col(text_col).alias("__text"))
    rows = claims.join(texts, "source_id", "left")
    piece = F.substring(F.col("__text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    verdict = (
        F.when(F.col("__text").isNull(), "missing_source")
        .when((F.col("start_offset") < 0) | (F.col("end_offset") <= F.col("start_offset")) | (F.col("end_offset") > F.length("__text")), "invalid_span")
        .when(F.col("excerpt").isNotNull() & (piece != F.col("excerpt")), "excerpt_mismatch")
        .when(F.col("excerpt_checksum").isNotNull() & (F.sha2(piece, 256) != F.col("excerpt_checksum")), "checksum_mismatch")
        .otherwise("ok")
    )
    return rows.select("claim_id", "source_id", verdict.alias("verdict"))


def trace(assertions: DataFrame, canonical: DataFrame, claims: DataFrame) -> DataFrame:
    """(canonical_id, claim_id, source_id, start_offset, end_offset, role): each
    assertion's supporting and opposing claims with their places.  Support that
    is no source claim keeps a row with null places."""
    a = assertions.select("canonical_id", F.explode("supporting").alias("claim_id"), F.lit("supporting").alias("role"))
    b = assertions.select("canonical_id", F.explode("opposing").alias("claim_id"), F.lit("opposing").alias("role"))
    places = claims.select("claim_id", "source_id", "start_offset", "end_offset")
    known = canonical.select("canonical_id")
    return a.unionAll(b).join(known, "canonical_id", "left_semi").join(places, "claim_id", "left").select("canonical_id", "claim_id", "source_id", "start_offset", "end_offset", "role")


def short_passages(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, block: int = 10_000) -> DataFrame:
    """(id, item_id, start_offset) of passages (item_id, passage) that occur in texts,
    wherever in their words they begin and end.

    The passages come to the driver in blocks of ``block`` of at most 100 characters
    each; texts are searched for a whole block at once, in one pass over them.
    """
    from functools import reduce

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    out = docs.select(F.col(id_col).cast("long").alias(id_col), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("start_offset")).limit(0)
    kind = ArrayType(StructType([StructField("item_id", LongType()), StructField("at", IntegerType())]))
    parts, own = [], []

    def searched(passages: list[tuple[int, str]]) -> DataFrame:
        @F.pandas_udf(kind)
        def find(texts):
            return texts.map(lambda t: [(i, t.find(p)) for i, p in passages if t is not None and p in t])

        return docs.select(F.col(id_col).cast("long").alias(id_col), F.explode(find(F.col(text_col))).alias("x")).select(id_col, "x.item_id", F.col("x.at").cast("long").alias("start_offset"))

    for r in items.orderBy("item_id").toLocalIterator():
        own.append((r.item_id, r.passage))
        if len(own) == block:
            parts.append(searched(own))
            own = []
    if own:
        parts.append(searched(own))
    return reduce(DataFrame.unionByName, parts, out)
