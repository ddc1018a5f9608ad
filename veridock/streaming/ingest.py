"""Streaming form of the incremental pipeline: new files in, new claims out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from veridock.operators import claims


def claim_stream(spark: SparkSession, source_dir: str, schema: str, out_dir: str, checkpoint_dir: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Extracts claims from each new Parquet file and appends those whose claim id
    hasn't been seen.

    Claim ids are content-derived and the state store remembers them, so neither a
    replayed batch nor a text that comes again adds anything, and the ledger is
    never read back.  The state is one id for each claim.  The sink commits a
    batch as a whole.  Runs until what is there is done.
    """
    rows = spark.readStream.schema(schema).parquet(source_dir)
    new = claims.source_claims(rows, id_col, text_col).dropDuplicates(["claim_id"])
    return new.writeStream.format("parquet").outputMode("append").option("path", out_dir).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Extension: counts and means per window and type; later events are dropped
    behind the watermark.  Works on streams and tables alike."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")


def observations_in_window(predictions: DataFrame, observations: DataFrame, late: str = "1 hour") -> DataFrame:
    """Extension: stream join of observations to predictions by id within the window and
    not before the information cutoff (where there is one).  The batch form names
    the observations that it refuses; this one leaves them out."""
    o = observations.withWatermark("observed_at", late)
    p = predictions.withWatermark("window_end", late)
    on = (o["spec_id"] == p["spec_id"]) & (o["observed_at"] >= p["window_start"]) & (o["observed_at"] <= p["window_end"])
    if "cutoff" in predictions.columns:
        on = on & (o["observed_at"] >= p["cutoff"])
    return p.join(o, on).select(p["spec_id"], o["observation_id"], o["observed_at"], o["value"])
