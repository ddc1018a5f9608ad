"""Claim queries on documents: repeated rows, and patterns that need no Unicode classes."""

import pytest
from pyspark.sql import functions as F

from veridock.functions import text as T
from veridock.operators import claims, queries

TEXT = "The cache reduces latency if load is high. All users should not trust caches when busy, but The queue is slow."


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def twice(spark, tmp_path):
    """Two documents under one id, a copy of one of them, and two of other sources."""
    rows = [(1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (1, TEXT + " The cat eats mice daily.", "en", "b"), (2, TEXT.upper(), "en", "b"), (3, "Nothing", "en", "c"), (None, TEXT, "en", "d")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_eligibility_counts_repeated_rows_once_each(spark, twice):
    found = queries.eligibility(spark, twice).agg(F.sum("n")).first()[0]
    assert found == claims.sentences(spark.read.parquet(f"{twice}/documents.parquet"), "doc_id", "text").count()


def test_tidied_patterns_equal_general_ones(spark):
    texts = [TEXT, "A\u0001 b  is\u0001not c d", "Fish tendſ to swim", "Some X may not fail unless Y stops", "Under a wide definition, growth means change", "Buy gold if safety is the objective", "Straße iſ lang hier", "No cat ever sleeps..", "Every note holds", "x should\u0001go\u0001\u0001now !"]
    p = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tidy(F.col("t")).alias("proposition"))
    own = ("claim_type", "subject", "relation", "object", "polarity", "quantifier", "modality", "definition", "conditions", "objective")
    assert _rows(claims.semantics(p, tidied=True).select(*own)) == _rows(claims.semantics(p).select(*own))


def test_shared_ids_are_merged_and_others_stay(spark, twice):
    """Claims of documents that share an id, or have none, count once by claim id;
    a claim of a shared id stands for the sources of all of its documents."""
    docs = spark.read.parquet(f"{twice}/documents.parquet")
    ids = claims.source_claims(docs, "doc_id", "text").select("claim_id").distinct().count()
    assert queries.canonical_abstentions(spark, twice).agg(F.sum("members")).first()[0] == ids
    cats = [r for r in queries.cross_source_support(spark, twice).collect() if r.subject == "the cat"]
    assert [(r.groups, r.sources) for r in cats] == [(2, "a,b")]


def test_distinct_claims_do_not_move(spark, sf_dir):
    """Documents with ids of their own: the only shuffles are the ones of the last two groupings and the spread scan."""
    plan = queries.canonical_claims(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(claim_id" not in plan and plan.count("Exchange hashpartitioning") <= 2
