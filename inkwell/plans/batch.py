"""A batch run over a folder: scan, skip what is unchanged, decode, render, score, write, and the next state.

The registry is a snapshot table; its keys are paths relative to the root. A run that fails leaves the last snapshot,
so that the next one takes up what it missed. A file has changed if the hash of its content has (by="content": each
run reads all files, and only hashes leave the scan), or if its size or time have (by="stat": a listing is enough).
The contents of changed files alone go to the decoders: the reader gets their paths, CHUNK at a time, as a listing in
the driver has them anyway. Files whose outputs are gone are converted again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.quality import with_quality
from inkwell.functions.render import document_markdown
from inkwell.operators import sinks, sync
from inkwell.sources.decoders import decode_files
from inkwell.sources.scan import files, relative, scan
from inkwell.streaming.state import Snapshots

VERSION = "1"
CHUNK = 10_000
REGISTRY = "rel string, hash string, status string, version string, pushed boolean, outputs array<string>"


@dataclass
class Report:
    scanned: int
    converted: int
    failed: int
    skipped: int
    vanished: int


def output_rel(path: Column) -> Column:
    """txt and csv keep their extension, md stays, other files change theirs; files of an archive lie in a folder of its name."""
    return F.when(path.rlike(r"(?i)\.(txt|csv)$"), F.concat(path, F.lit(".md"))).when(path.rlike(r"(?i)\.md$"), path).otherwise(F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".md")))


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df as a table of the run: what the folder held when it was listed, whatever comes later."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _contents(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path (relative) and content of these files, and of no others."""
    exact = [re.sub(r"([\\{}\[\]*?,^])", r"\\\1", p) for p in paths]  # names are no globs
    found = spark.read.format("binaryFile").load(exact)
    return found.select(relative(F.col("path"), root).alias("path"), "content")


def run_batch(spark: SparkSession, root: str, out: str, state: str, by: str = "content") -> Report:
    registry = Snapshots(spark, f"{state}/registry", REGISTRY)
    known = registry.versions()
    number = known[-1] + 1 if known else 0  # old versions go, numbers don't come again
    mark = F.sha1("content") if by == "content" else F.sha1(F.concat_ws("|", "size", F.unix_micros("modified")))
    current = _kept(scan(spark, root).select("rel", "path", mark.alias("hash")), f"{state}/scan/run={number}")
    before = registry.read()
    recorded = before.select(F.col("rel").alias("source"), F.explode("outputs").alias("path"))
    on_disk = files(spark, out).select(F.col("rel").alias("path"))
    skip = sync.skip_complete(current, before.filter("status = 'converted'"), recorded.withColumnRenamed("source", "rel"), on_disk, "rel", VERSION)
    todo = current.join(skip.select(F.col("rel").alias("_skip")), F.col("rel") == F.col("_skip"), "left_anti").select("rel", "path", "hash")
    todo = _kept(todo, f"{state}/todo/run={number}")
    paths = [r["path"] for r in todo.select("path").orderBy("path").toLocalIterator()]
    table = f"{state}/outputs/run={number}"
    columns = ["source", "path", "rel", "kind", "error", "detail", "markdown", "score"]
    for at in range(0, max(1, len(paths)), CHUNK):
        chosen = _contents(spark, root, paths[at : at + CHUNK]) if paths else spark.createDataFrame([], "path string, content binary")
        made = decode_files(chosen).withColumn("markdown", document_markdown(F.col("blocks"))).withColumn("rel", output_rel(F.col("path")))
        with_quality(made, "markdown").select(*columns).write.mode("append" if at else "overwrite").parquet(table)
    outputs = spark.read.parquet(table)
    written = sinks.write_markdown(outputs.filter("error IS NULL"), out)
    sinks.manifest(written, f"{state}/manifest/run={number}")
    by_source = outputs.groupBy("source").agg(F.max(F.col("error").isNull()).alias("ok"), F.collect_set(F.when(F.col("error").isNull(), F.col("rel"))).alias("outputs"))
    done = todo.join(by_source, F.col("rel") == F.col("source"), "left")
    rows = done.select("rel", "hash", F.when(F.col("ok"), "converted").otherwise("failed").alias("status"), F.lit(VERSION).alias("version"), F.coalesce("outputs", F.array().cast("array<string>")).alias("outputs"))
    gone = _kept(sync.vanished(registry.read(), current, "rel").select("rel"), f"{state}/gone/run={number}")
    n_gone = gone.count()
    counts = {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    scanned = current.count()

    def change(old: DataFrame) -> DataFrame:
        kept = old.join(gone.select(F.col("rel").alias("_gone")), F.col("rel") == F.col("_gone"), "left_anti")
        new = rows.select("rel", "hash", "status", "version", F.lit(False).alias("pushed"), "outputs")
        stay = kept.join(new.select(F.col("rel").alias("_new")), F.col("rel") == F.col("_new"), "left_anti")
        return stay.unionByName(new)

    stale = before.join(gone.select(F.col("rel").alias("_gone")), F.col("rel") == F.col("_gone"), "left_semi").select("rel", F.explode("outputs").alias("path"))
    stale.write.mode("overwrite").json(f"{state}/vanished/run={number}")  # the outputs of files that went, for whoever deletes them

    registry.update(change)
    total = sum(counts.values())
    return Report(scanned, counts.get("converted", 0), counts.get("failed", 0), scanned - total, n_gone)


def quality_report(outputs: DataFrame) -> DataFrame:
    """Scores by kind of source: count, least, greatest, mean in tenths, and how many are low."""
    return outputs.filter("error IS NULL").groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.bround(F.avg("score").cast("decimal(8,4)"), 1).cast("double").alias("mean"), F.sum((F.col("score") < 50).cast("long")).alias("low")
    )
