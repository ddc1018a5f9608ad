"""File sources: scans, extraction with partial failure, manifests, budgets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridock.functions import identity as J
from veridock.functions import text as T
from veridock.sources import formats

MANIFEST = "schema_version string, id string, name string, domain_profile string, configuration_ref string, created_at string, source_entries array<struct<source_id:string,input_ref:string,media_type:string,metadata_overrides:struct<title:string,creators:array<string>,rights_or_access_notes:string>>>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


#: Sources of a corpus: text whose places are exact.
TEXT_SUFFIXES = [".adoc", ".asciidoc", ".markdown", ".md", ".rst", ".text", ".txt"]


def missing_paths(spark: SparkSession, *paths: str) -> list[str]:
    """Those of ``paths`` (files, folders, globs) that match nothing."""
    out = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        if found is None or len(found) == 0:
            out.append(path)
    return out


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """(ord, path, length, content) of the supported files under ``paths`` (files,
    folders, globs), each file once, at its first place: arguments in order,
    then by lower-case path.  ``ord`` (argument number, lower-case path) sorts them.
    Paths that match nothing give no rows; :func:`missing_paths` names them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    lost = set(missing_paths(spark, *paths))
    parts = None
    for k, path in enumerate(paths):
        one = spark.createDataFrame([], schema) if path in lost else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        one = one.withColumn("arg", F.lit(k))
        parts = one if parts is None else parts.unionAll(one)
    kept = parts.where(suffix(F.col("path")).isin(*formats.SUFFIXES))
    first = F.row_number().over(Window.partitionBy("path").orderBy("arg"))
    return kept.withColumn("r", first).where("r = 1").select(F.struct("arg", F.lower("path").alias("name")).alias("ord"), "path", "length", "content")


def html_text(pages: DataFrame, html_col: str = "html") -> Column:
    """Text of an HTML column."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def convert(col: pd.Series) -> pd.Series:
        return col.map(lambda x: None if x is None else formats.from_html(x))

    return convert(F.col(html_col))


def extract(files: DataFrame) -> DataFrame:
    """(path, text, error, removed, tokens) per file.  A file that can't be read, or
    without visible text, has a null text and an error; the others go on."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                text = error = None
                try:
                    name = path.rpartition("/")[2]
                    text = formats.extract(bytes(content), ("." + name.rpartition(".")[2].lower()) if "." in name else "")
                    if not text.strip():
                        text, error = None, "no visible text"
                except Exception as e:  # noqa: BLE001 - any failure belongs to this file alone
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, text, error))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    raw = files.select("path", "content").mapInPandas(run, "path string, text string, error string")
    return raw.select("path", T.sanitize(F.col("text")).alias("text"), "error", T.removed_invisible(F.col("text")).alias("removed"), T.estimate_tokens(F.col("text")).alias("tokens"))


def consolidate(texts: DataFrame, order_col: str) -> DataFrame:
    """One row: all texts in order behind banners, with totals.  The result is one
    document by definition; its size is the caller's budget."""
    banner = F.concat(F.lit("=" * 80 + "\nSOURCE: "), F.regexp_extract("path", r"([^/]+)$", 1), F.lit("\n" + "=" * 80 + "\n\n"), F.col("text"), F.lit("\n\n"))
    rows = texts.where("text IS NOT NULL").select(F.col(order_col).alias("o"), banner.alias("b"), "tokens", F.length("text").alias("chars"))
    return rows.agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "b"))), lambda x: x["b"]), "")).alias("full_text"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"), F.count("*").alias("sources"))


def metadata(files: DataFrame, texts: DataFrame, mode: str = "text") -> DataFrame:
    """One row per source with its metrics: path, filename, format, mode, file_size_mb,
    chars, words, estimated_tokens, chapters, has_contents; failed sources have
    none."""
    from veridock.operators import structure

    size = files.select("path", F.round(F.col("length") / 1048576, 2).alias("file_size_mb"))
    found = structure.detect(texts.where("text IS NOT NULL"), "path", "text").select("path", "chapters", "has_contents")
    rows = texts.where("text IS NOT NULL").join(size, "path").join(found, "path")
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), suffix(F.col("path")).alias("format"), F.lit(mode).alias("mode"), "file_size_mb", F.length("text").alias("chars"), T.word_count(F.col("text")).alias("words"), F.col("tokens").alias("estimated_tokens"), "chapters", "has_contents")


def totals(meta: DataFrame) -> DataFrame:
    """One row: what :func:`metadata` adds up to.  A single source keeps its name and
    format, several are ``multi-source`` and ``mixed``."""
    one = F.count("*") == 1
    agg = meta.agg(
        F.count("*").alias("total_sources"), F.when(one, F.first("filename")).otherwise("multi-source").alias("filename"), F.when(one, F.first("format")).otherwise("mixed").alias("format"), F.first("mode").alias("mode"),
        F.round(F.sum("file_size_mb"), 2).alias("file_size_mb"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.sum("estimated_tokens").alias("estimated_tokens"),
    )
    return agg.withColumn("estimated_tokens_human", F.concat(F.lit("~"), F.floor(F.col("estimated_tokens") / 1000).cast("string"), F.lit("K")))


def manifest_violations() -> Column:
    """Reasons why a manifest row can't be used; empty for a good one."""
    e = F.col("source_entries")
    refs, ids = F.transform(e, lambda x: x["input_ref"]), F.transform(e, lambda x: x["source_id"])
    bad_ref = lambda r: r.isNull() | T.is_absolute_ref(r) | r.contains("://") | r.contains("//") | r.rlike(r"(^|[/\\])\.\.([/\\]|$)")
    checks = [
        (~F.col("schema_version").eqNullSafe("1.0"), "schema_version"), (F.coalesce(F.size(e), F.lit(0)) < 2, "fewer than two sources"),
        (F.size(F.array_distinct(ids)) != F.size(ids), "repeated source id"), (F.exists(ids, lambda i: i.isNull() | ~i.rlike("^[a-z0-9][a-z0-9_-]*$")), "source id"),
        (F.exists(refs, bad_ref), "input reference"), (F.coalesce(F.trim("id"), F.lit("")) == "", "id"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for test, name in checks]))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per source entry; an unknown field or any violation is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\x{FEFF}", "").alias("value"))
    known = [f.name for f in spark.createDataFrame([], MANIFEST).schema]
    m = raw.select("value", F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("value", "m.*")
    extra = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(k) for k in known]))
    problems = F.concat(manifest_violations(), F.transform(extra, lambda k: F.concat(F.lit("unknown field "), k)))
    ok = F.when(F.size(problems) == 0, F.col("source_entries")).otherwise(F.raise_error(F.array_join(problems, "; ")))
    return m.select(F.col("id").alias("corpus_id"), "configuration_ref", F.explode(ok).alias("e")).select("corpus_id", "configuration_ref", "e.*")


def check_budget(files: DataFrame, sources: int = 1000, each_bytes: int = 50 << 20, total_bytes: int = 500 << 20) -> None:
    """Raises if the files exceed the budget."""
    r = files.agg(F.count("*").alias("n"), F.max("length").alias("m"), F.sum("length").alias("t")).first()
    if r.n > sources or (r.m or 0) > each_bytes or (r.t or 0) > total_bytes:
        raise ValueError(f"over budget: {r.n} sources, largest {r.m}, total {r.t} bytes")


def ingest(entries: DataFrame, files: DataFrame, root: str, again: DataFrame | None = None) -> DataFrame:
    """Sources of a manifest with text, checksums, title and id; one that is missing,
    unreadable or no plain text stays as a limitation (null text with an error).

    ``again`` are the same files read once more: a source whose content differs
    there changed while it was read, and is an error.
    """
    ref = F.regexp_replace(F.regexp_replace(F.col("path"), r"^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    read = extract(files).withColumn("ref", ref)
    sums = files.select("path", F.sha2("content", 256).alias("checksum"))
    joined = entries.join(read.join(sums, "path"), F.col("input_ref") == F.col("ref"), "left")
    if again is None:
        joined = joined.withColumn("later", F.col("checksum"))
    else:
        joined = joined.join(again.select("path", F.sha2("content", 256).alias("later")), "path", "left")
    problem = (
        F.when(~suffix(F.col("input_ref")).isin(TEXT_SUFFIXES), "no plain text").when(F.col("path").isNull(), "missing")
        .when(~F.col("checksum").eqNullSafe(F.col("later")), "changed while it was read").otherwise(F.col("error"))
    )
    joined = joined.withColumn("error", problem).withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
    heading = F.nullif(F.regexp_extract("text", r"(?m)^\s*#+\s+(\S.*?)\s*$", 1), F.lit(""))
    title = F.coalesce("metadata_overrides.title", heading, F.regexp_extract("input_ref", r"([^/]+?)(?:\.[^./]*)?$", 1))
    media = F.coalesce("media_type", F.when(suffix(F.col("input_ref")).isin(".md", ".markdown"), "text/markdown").otherwise("text/plain"))
    payload = J.json_object(corpus_id=J.json_string(F.col("corpus_id")), source_id=J.json_string(F.col("source_id")), content_checksum=J.json_string(F.col("checksum")), parser_version=F.lit('"1"'))
    return joined.select("source_id", F.when(F.col("text").isNotNull(), J.stable_id("source", payload)).alias("record_id"), title.alias("title"), media.alias("media"), "checksum", F.sha2("text", 256).alias("text_checksum"), F.col("removed").alias("removed_invisible"), "text", "error")


def fingerprint(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
