"""Readers of the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch: a worker holds two of them, and what it makes of their rows.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as there are cores, where its scan has fewer: for work that costs far more than moving so small an input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_batches(spark: SparkSession) -> None:
    """Lets Arrow batches end with the row that passes BATCH_BYTES, whatever the number and the size of the rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
