"""Relations between kinds of claims stand for all pairs of claims, and don't grow with repeated content."""

from pyspark.sql import functions as F

from veridock.operators import canonical, ladder_queries, relations, synthesis


def _suppliers(spark, copies):
    """Fields repeat after 70,049 keys."""
    ids = spark.range(150).crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))
    return ids.select((F.col("id") + 1 + 70049 * F.col("copy")).alias("s_suppkey"), (F.col("id") % 7 + F.col("copy")).alias("s_nationkey"))


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_kinds_do_not_grow_with_copies(spark):
    one, three = (ladder_queries.graph(_suppliers(spark, n)) for n in (1, 3))
    assert three[0].count() > one[0].count()  # abstentions stay alone
    assert three[1].count() == one[1].count()


def test_kinds_equal_pairs(spark):
    s = _suppliers(spark, 2)
    own = ladder_queries.supplier_claims(s)
    k = canonical.canonicalize(own).cache()
    f = relations.features(k)
    r = relations.classify(f, relations.candidates(f)).cache()
    count = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n"))
    assert _rows(ladder_queries.labels(s)) == _rows(count(r.select(F.explode("conflict_dimensions").alias("dimension"), "relation_type"), "dimension", "relation_type"))
    assert ladder_queries.ladder(s).agg(F.sum("n")).first()[0] == r.count()
    assert _rows(ladder_queries.statuses(s)) == _rows(count(synthesis.assertions(k, r, own.select("claim_id", "grp")), "status"))
    d = synthesis.described_disputes(r, k)
    some = lambda c: F.sum((F.size(c) > 0).cast("long"))
    want = d.groupBy("conflict_type", "status").agg(some("shared_assumptions").alias("sharing"), some("differing_assumptions").alias("differing"), F.count("*").alias("n"))
    assert _rows(ladder_queries.disputes(s)) == _rows(want)
