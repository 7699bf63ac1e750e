"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; texts and pages are dealt to as many tasks as there are cores, where the scan has fewer."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name in ("documents", "pages") and found.rdd.getNumPartitions() < cores else found


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A folder of our own is set only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkwell-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage.

    The files survive the loss of executors; Hadoop deletes them when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold at most BATCH_ROWS rows of whole texts, as both the JVM and a worker hold a batch in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: Catalyst would put a copy of it in each lambda."""
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text; null and empty are one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def words_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", -1), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for a row: its id and its whole text."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))))


def tidy(run: Callable, *drop: Callable[[], None]) -> Callable:
    """run, a function of Arrow batches, that leaves no memos and no freed memory behind in its worker, which later stages share."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            for d in drop:
                d()
            gc.collect()
            give_back()

    return wrapped


def give_back() -> None:
    """Returns freed memory to the system: Arrow's and the C library's allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def row_of(df: DataFrame) -> Column:
    """All columns of df in one struct, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def with_text(row: Column, names: list[str], text: Column) -> list[Column]:
    """The columns `names` of the struct `row`, with another text (and n_chars, if there is such a column)."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(n, row.getField(n)).alias(n) for n in names]
