"""Where results go: Markdown files, tables, manifests, and an outbox with a dead letter table."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import rel_path


def write_markdown(df: DataFrame, root: str) -> DataFrame:
    """Writes column markdown to root/rel, a folder that all executors share; returns rel, bytes, sha256 once it is run."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for rel, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(root, rel)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                data = (text or "").encode("utf-8", "replace")
                with open(path + ".part", "wb") as f:
                    f.write(data)
                os.replace(path + ".part", path)  # a task that runs again leaves the same file
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2)], ["rel", "bytes", "sha256"])

    return df.select(rel_path(F.col("rel")).alias("rel"), "markdown", F.sha2("markdown", 256).alias("sha256")).mapInArrow(write, "rel string, bytes long, sha256 string")


def manifest(written: DataFrame, path: str) -> None:
    """One JSON line a file."""
    written.orderBy("rel").write.mode("overwrite").json(path)


def copy_files(plan: DataFrame, root: str) -> DataFrame:
    """Writes content to root/goal (goal, content) in a folder that all executors share, where it isn't there in that size; goal and whether it was copied."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for goal, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(root, goal)
                new = not os.path.isfile(path) or os.path.getsize(path) != len(data)
                if new:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(path + ".part", "wb") as f:
                        f.write(data)
                    os.replace(path + ".part", path)
                done.append(new)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done)], ["goal", "copied"])

    return plan.select(rel_path(F.col("goal")).alias("goal"), "content").mapInArrow(copy, "goal string, copied boolean")


def append_scores(scores: DataFrame, path: str) -> None:
    """Adds rows (ts, file, ok, score, seconds, chars, error) to a folder of CSV files, by file."""
    scores.select("ts", "file", "ok", "score", "seconds", "chars", "error").orderBy("file").write.mode("append").option("header", "true").csv(path)


def dead_letters(sent: DataFrame, path: str) -> None:
    """Appends what failed as JSON lines; `retry` takes it from there."""
    sent.filter("status = 'dead'").withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def retry(spark, path: str, rendered: DataFrame) -> DataFrame:
    """The rows (rel, markdown) of `rendered` whose last delivery failed, each once."""
    failed = spark.read.schema("rel string, status string, attempts int, detail string").json(path).select(F.col("rel").alias("_rel")).distinct()
    return rendered.join(failed, F.col("rel") == F.col("_rel"), "left_semi").select("rel", "markdown")


def deliver(outbox: DataFrame, send: Callable[[str, str], str], retries: int = 3, delay: float = 0.0) -> DataFrame:
    """rel, status, attempts, detail of sending each row (rel, markdown).

    send returns an id, raises FileExistsError for what is already there (a success), and anything else is tried
    again after `delay` seconds. Rows that fail are the dead letters; the result is a table, so a later run takes them
    from there. Partitions are sent at the same time: repartition(n) is the number of senders.
    """

    def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rel, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                status, attempts, detail = "dead", 0, ""
                while attempts < retries and status == "dead":
                    if attempts and delay:
                        time.sleep(delay)
                    attempts += 1
                    try:
                        detail, status = send(rel, text), "sent"
                    except FileExistsError:
                        detail, status = "", "exists"
                    except Exception as e:  # noqa: BLE001  any failure is tried again
                        detail = str(e)[:300]
                out.append((rel, status, attempts, detail))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["rel", "status", "attempts", "detail"])

    return outbox.select("rel", "markdown").mapInArrow(push, "rel string, status string, attempts int, detail string")
