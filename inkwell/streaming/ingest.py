"""Streams: new files to Markdown rows, changes of a folder, and event rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.quality import with_quality
from inkwell.functions.render import document_markdown
from inkwell.sources.decoders import decode_files
from inkwell.sources.scan import excluded, files

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """Each file once by its path; `per_trigger` bounds a batch."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    return found.filter(~excluded(F.element_at(F.split("path", "/"), -1)))


def to_markdown(found: DataFrame) -> DataFrame:
    """source, path, kind, markdown, sha256, error and quality of files (path, content), in a batch or a stream."""
    made = decode_files(found.select("path", "content")).withColumn("markdown", document_markdown(F.col("blocks")))
    return with_quality(made, "markdown").select("source", "path", "kind", "markdown", F.sha2("markdown", 256).alias("sha256"), "error", "score")


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str) -> None:
    """Converts what is new under root to Parquet in `out`, and stops; a restart goes on where the last run ended."""
    stream = to_markdown(new_files(spark, root)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def appeared(spark: SparkSession, root: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that the last tick didn't have, what this tick knows): a path that went and came back appears again."""
    now = files(spark, root).filter(~excluded(F.col("rel"))).select("rel")
    before = known.select(F.col("rel").alias("_rel"))
    return now.join(before, F.col("rel") == F.col("_rel"), "left_anti"), now


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; rows later than `late` are left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
