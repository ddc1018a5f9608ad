"""Bounded labelled samples for the classifiers.

A sample is the rows with the smallest hash of their id, so it doesn't depend
on file layout or on the order of rows.  A text longer than ``max_chars`` is
represented by pieces of ``PIECE_CHARS`` characters from anywhere in it (those
with the smallest hash, in the text's order), so a sample has a fixed size and
no text is learned by its beginning alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE_CHARS = 1_000
#: Most languages that get their full number of texts.
FULL_CLASSES = 20


def remainder(id_col: Column | str, modulus: int) -> Column:
    """``crc32`` of the id's decimal text modulo ``modulus``; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus))


def excerpt(text: str, max_chars: int) -> Column:
    """The text, or pieces from everywhere in it that have ``max_chars`` characters together."""
    pieces = f"transform(sequence(0, (length({text}) - 1) div {PIECE_CHARS}), i -> substring({text}, i * {PIECE_CHARS} + 1, {PIECE_CHARS}))"
    keyed = f"transform({pieces}, (p, i) -> named_struct('h', xxhash64(p, i), 'i', i, 'p', p))"
    chosen = f"transform(slice(array_sort({keyed}), 1, {max(1, max_chars // PIECE_CHARS)}), x -> named_struct('i', x.i, 'p', x.p))"
    return F.expr(f"if(length({text}) <= {max_chars}, {text}, array_join(transform(array_sort({chosen}), x -> x.p), ' '))")


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, where: Column, max_rows: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``max_rows`` (text, label) pairs, each text at most ``max_chars``
    characters (and a blank between pieces).

    Labels that are null, or whose id is null or fails ``where``, are never
    read.  Of documents that repeat an id the smallest excerpt counts; an id
    with two labels is a pair for each.  The broadcast side has at most
    ``max_rows`` rows of two numbers.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull()).where(where)
    chosen = chosen.dropDuplicates().orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(excerpt("text", max_chars)).alias("text")).collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.id, r.label))]


def texts_by_class(docs: DataFrame, id_col: str, text_col: str, class_col: str, where: Column, per_class: int, max_chars: int) -> dict[str, list[str]]:
    """At most ``per_class`` texts of each non-null value of ``class_col``, as in
    :func:`labelled_texts`; beyond ``FULL_CLASSES`` classes each gets as many
    times fewer texts, one at least."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(class_col).alias("cls"), F.col(text_col).cast("string").alias("text"))
    ids = ids.where(F.col("id").isNotNull() & F.col("cls").isNotNull() & (F.length("text") > 0)).where(where)
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.xxhash64("id"), "id"))
    ranked = ids.select("id", "cls").withColumn("rank", rank).where(F.col("rank") <= per_class)
    classes = ranked.select("cls").distinct().count()
    if classes > FULL_CLASSES:
        ranked = ranked.where(F.col("rank") <= max(1, per_class * FULL_CLASSES // classes))
    rows = ids.join(F.broadcast(ranked.select("id", "cls").dropDuplicates()), ["id", "cls"]).groupBy("cls", "id").agg(F.min(excerpt("text", max_chars)).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.cls, r.id)):
        out.setdefault(r.cls, []).append(r.text)
    return out
