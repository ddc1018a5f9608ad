"""Query op5: verdict on every page's URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridock.llm import urlfilter

RULES = urlfilter.Rules.of([("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; a null URL has an empty host and path."""
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).select("page_id", "host", "path", "rule", "verdict")
