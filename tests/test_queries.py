"""Every query that has an SQL form equals it on the smallest scale."""

import glob
import os

import pytest

from veridock.operators import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _rows(frame, columns):
    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in values)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    if name not in queries.SQL:
        assert len(got) > 0
        return
    want = duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, sorted(got.columns)) == _rows(want, sorted(want.columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream(spark, sf_dir, tmp_path):
    from veridock.operators import claims
    from veridock.streaming.ingest import claim_stream, windowed_events

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        claim_stream(spark, f"{tmp_path}/in", "doc_id long, text string", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        docs.limit(5).write.mode("append").parquet(f"{tmp_path}/in")  # seen before: nothing new
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("claim_id").distinct().count() == claims.source_claims(docs, "doc_id", "text").select("claim_id").distinct().count()
    assert windowed_events(spark.read.parquet(f"{sf_dir}/events.parquet")).count() > 0
