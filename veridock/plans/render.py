"""Deterministic reports: one text per document, with checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.functions import text as T

STATUS_ORDER = ["consensus", "conditional", "contested", "minority_view", "unresolved"]
PATTERNS = ["agreement", "alternative", "conditional_disagreement", "contradiction", "equivalent", "qualification", "tension"]


def status_rank(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status), F.lit(len(STATUS_ORDER) + 1))


def safe_text(text: Column, fallback: str = "[withheld: unsafe source text]") -> Column:
    """Sanitised, collapsed and escaped text; instruction-shaped text is withheld."""
    clean = T.collapse(T.sanitize(text))
    return F.when(F.size(T.safety_rules(clean)) > 0, F.lit(fallback)).otherwise(T.escape_markdown(clean))


def locator(section: Column, paragraph: Column, start: Column, end: Column) -> Column:
    """Place of a span; missing parts are left out."""
    span = F.when(start.isNotNull(), F.concat(F.lit("characters "), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.concat_ws("; ", F.concat(F.lit("section "), section), F.concat(F.lit("paragraph "), paragraph.cast("string")), span)


def assertion_lines(assertions: DataFrame) -> DataFrame:
    """(canonical_id, status, line): one list item per assertion."""
    note = F.when(F.col("condition_summary").isNotNull(), F.concat(F.lit(" (applies: "), safe_text(F.col("condition_summary")), F.lit(")")))
    counts = F.concat(F.lit(" ["), F.size("supporting").cast("string"), F.lit(" for, "), F.size("opposing").cast("string"), F.lit(" against]"))
    return assertions.select("canonical_id", "status", F.concat(F.lit("- "), safe_text(F.col("text")), F.coalesce(note, F.lit("")), counts).alias("line"))


def cheatsheet(assertions: DataFrame) -> DataFrame:
    """(status, rank, line) of all assertions by status, then id."""
    lines = assertion_lines(assertions)
    order = Window.partitionBy("status").orderBy("canonical_id")
    return lines.select("status", F.row_number().over(order).alias("rank"), "line")


def chapters(clusters: DataFrame, assertions: DataFrame) -> DataFrame:
    """(path, text, sha256): one chapter per topic, numbered by topic and id, its
    assertions by status and id."""
    rows = clusters.select("cluster_id", "topic", F.explode("canonical_ids").alias("canonical_id")).join(assertion_lines(assertions), "canonical_id")
    body = F.array_sort(F.collect_list(F.struct(status_rank(F.col("status")).alias("r"), "canonical_id", "line")))
    texts = rows.groupBy("cluster_id", "topic").agg(F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("body"))
    texts = texts.withColumn("slug", T.slug("topic")).withColumn("text", F.concat(F.lit("# "), safe_text(F.col("topic")), F.lit("\n\n"), F.col("body"), F.lit("\n")))
    numbered = number_rows(texts, ["topic", "cluster_id"])
    digits = F.when(F.col("number") < 100, F.lpad(F.col("number").cast("string"), 2, "0")).otherwise(F.col("number").cast("string"))
    path = F.concat(F.lit("chapters/"), digits, F.lit("-"), F.col("slug"), F.lit(".md"))
    return numbered.select(path.alias("path"), "text", F.sha2("text", 256).alias("sha256"))


def number_rows(df: DataFrame, by: list[str]) -> DataFrame:
    """``number``: 1-based global order without a single-partition window: range
    partitions, counted, then numbered one by one in parallel."""
    from veridock.plans.scratch import materialise

    parts = materialise(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "order")
    counts = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    offsets = counts.select("__part", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    return parts.withColumn("number", inside).join(offsets, "__part").withColumn("number", F.col("number") + F.col("__before")).drop("__part", "__before")


def glossary(claims: DataFrame) -> DataFrame:
    """(term, definitions): recorded definitions by normal form, distinct and sorted."""
    rows = claims.where(F.col("definition").isNotNull())
    return rows.groupBy(T.normalized(F.col("definition")).alias("term")).agg(F.array_join(F.array_sort(F.collect_set(safe_text(F.col("proposition")))), "\n").alias("definitions"))


def patterns(relations: DataFrame) -> DataFrame:
    """(relation_type, line) of relations worth reporting."""
    rows = relations.where(F.col("relation_type").isin(PATTERNS))
    dims = F.when(F.size("conflict_dimensions") > 0, F.concat(F.lit(": "), F.array_join("conflict_dimensions", ", "))).otherwise(F.lit(""))
    return rows.select("relation_type", F.concat(F.lit("- "), F.col("l"), F.lit(" / "), F.col("r"), dims).alias("line"))


def traceability(trace: DataFrame) -> DataFrame:
    """(canonical_id, json): each assertion's claims and places, sorted."""
    item = F.struct("role", "claim_id", F.col("source_id").cast("string").alias("source_id"), "start_offset", "end_offset")
    return trace.groupBy("canonical_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"))


def stale_outputs(previous: DataFrame, current: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Files (path, sha256) of earlier runs that may go: no longer written, and
    unchanged since; a changed one is an error."""
    gone = previous.join(current.select("path"), "path", "left_anti").join(on_disk.select("path", F.col("sha256").alias("now")), "path")
    verdict = F.when(F.col("sha256") == F.col("now"), True).otherwise(F.raise_error(F.concat(F.lit("modified output: "), F.col("path"))).cast("boolean"))
    return gone.where(verdict).select("path", "sha256")
