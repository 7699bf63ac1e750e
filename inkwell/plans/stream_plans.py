"""Streams run to their end, so that their result can be compared."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.tables import table
from inkwell.streaming import ingest


#: Longer than the events' whole time, so that each user and type comes once.
WITHIN = "3650 days"


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="inkwell-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type from a stream of the events' file; the last complete state is the result."""
    top = _folder(spark)
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    counts = ingest.window_counts(events).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")
    ingest.run_available(counts, lambda df, i: df.write.mode("overwrite").parquet(f"{top}/out"), f"{top}/checkpoint", "complete")
    return spark.read.parquet(f"{top}/out")


def stream_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each user and type in a stream. State is kept for WITHIN of event time; a batch that runs again replaces its rows."""
    top = _folder(spark)
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    timed = events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", WITHIN)
    first = timed.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
    ingest.run_available(first, lambda df, i: df.write.mode("overwrite").parquet(f"{top}/out/batch={i}"), f"{top}/checkpoint", "append")
    return spark.read.parquet(f"{top}/out").select("user_id", "event_type")


QUERIES = {
    "stream_event_windows": (stream_event_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_dedup_events": (stream_dedup_events, "SELECT DISTINCT user_id, event_type FROM events"),
}
