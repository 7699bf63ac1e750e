"""Aggregates that Spark doesn't name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(value: str, by: list[str], df: DataFrame) -> DataFrame:
    """by and the value at place n // 2 (from 0) of each group's sorted values, as `median`.

    Equal values are counted before they meet, so that a group costs as many rows as it has distinct values.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumn("_upto", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    middle = F.floor(F.col("_all") / 2)
    return placed.filter((F.col("_upto") > middle) & (F.col("_upto") - F.col("_n") <= middle)).select(*by, F.col(value).alias("median"))


def percent(part: Column, whole: Column) -> Column:
    """round(100 * part / whole, 1), or 0 of nothing."""
    return F.when(whole > 0, F.bround((100 * part).cast("decimal(24,6)") / whole, 1).cast("double")).otherwise(F.lit(0.0))


def score_gate(frozen: DataFrame, now: DataFrame, key: str, by: str, each: int = 5, mean: int = 3) -> DataFrame:
    """by, n, n_fell (documents that fell by more than `each`), fall, fails (any of these, or a mean fall above `mean`).

    frozen: key, by, score; now: key, score. A document that has no score now counts as fallen to 0.
    """
    current = now.select(F.col(key).alias("_key"), F.col("score").alias("_now"))
    fall = F.col("score") - F.coalesce("_now", F.lit(0))
    joined = frozen.join(current, F.col(key) == F.col("_key"), "left").select(by, fall.alias("f"))
    sums = joined.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("f") > each).cast("long")).alias("n_fell"), F.sum("f").alias("fall"))
    return sums.withColumn("fails", (F.col("n_fell") > 0) | (F.col("fall") > mean * F.col("n")))


def unjudged(pairs: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """pairs that no earlier run has judged."""
    return pairs.join(judged.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")
