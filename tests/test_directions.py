from veridock.operators import prediction, queries


def test_directions_without_events(spark, sf_dir, tmp_path):
    """Every spelling has its row, as in SQL, and no row of events is repeated for it."""
    spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 0").write.parquet(f"{tmp_path}/events.parquet")
    out = queries.prediction_directions(spark, str(tmp_path))
    rows = out.collect()
    assert {r.direction for r in rows} == {s.replace("_", " ") for own in prediction.DIRECTIONS.values() for s in own} and len(rows) == 20
    assert all(r.n == 0 and r.hits is None for r in rows)
