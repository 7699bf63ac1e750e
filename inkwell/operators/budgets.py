"""Budgets over ordered rows, gaps, numbering and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(df: DataFrame, group: list[str], order: list[str], rows: int, cells: int, chars: int, n_cells: Column, n_chars: Column) -> DataFrame:
    """df with kept and reason (rows, cells, chars): a row goes in while there are fewer than `rows`, its cells fit, and the characters before it are fewer than `chars`.

    Sums only grow, so the first row over a budget ends its group. A group too large for a task is one sheet.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    placed = df.withColumns({"_row": F.row_number().over(w), "_cells": F.sum(n_cells).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_before": F.coalesce(F.sum(n_chars).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    reason = F.when(F.col("_row") > rows, "rows").when(F.col("_cells") > cells, "cells").when(F.col("_before") >= chars, "chars")
    return placed.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).drop("_row", "_cells", "_before")


def greedy_budget(df: DataFrame, group: str, order: str, size: str, single: int, total: int) -> DataFrame:
    """group, order, verdict (kept, too large, over budget): in order, each item that fits in what is left is kept; skipped ones use nothing.

    A group's items are folded in one row, as each verdict depends on all before it.
    """
    items = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<o:{df.schema[order].dataType.simpleString()},verdict:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (x["s"] <= single) & (acc["used"] + x["s"] <= total)
        verdict = F.when(x["s"] > single, "too large").when(fits, "kept").otherwise("over budget")
        return F.struct((acc["used"] + F.when(fits, x["s"]).otherwise(0)).alias("used"), F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), verdict.alias("verdict")))).alias("out"))

    return items.select(group, F.explode(F.aggregate("items", start, step)["out"]).alias("x")).select(group, F.col("x.o").alias(order), F.col("x.verdict").alias("verdict"))


def islands(df: DataFrame, group: str, order: Column, gap: Column) -> DataFrame:
    """df with island: a number that grows where the distance to the row before exceeds gap."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.when(F.coalesce(order - F.lag(order).over(w) > gap, F.lit(False)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def last_n(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The n rows of each group that come first in `order`; Spark limits groups before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def round_robin(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows in turns over the groups, which come in the order of their names."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return last_n(df, group, [F.col(order)], n).withColumn("turn", turn).orderBy("turn", group).limit(n)
