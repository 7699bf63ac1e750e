"""Boxes of recognised text: tiles of large images, fragments at seams, cells, and the confidence of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tile size and overlap, and thresholds of a result's confidence.
TILE, OVERLAP = 960, 96
LOW_SCORE, LARGE_SIDE = 0.62, 200


def tile_starts(side: Column, size: int = TILE, overlap: int = OVERLAP) -> Column:
    """Starts of tiles along a side: steps of size - overlap, and a last tile that ends with the side."""
    step = size - overlap
    regular = F.sequence(F.lit(0), F.greatest(F.lit(0), side - size), F.lit(step))
    last = side - size
    return F.when(side <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array(last))))


def tiles(images: DataFrame, size: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """images (width, height, other columns) with x0, y0, x1, y1 of each tile."""
    at = images.withColumn("x0", F.explode(tile_starts(F.col("width"), size, overlap))).withColumn("y0", F.explode(tile_starts(F.col("height"), size, overlap)))
    return at.withColumn("x1", F.least("width", F.col("x0") + size)).withColumn("y1", F.least("height", F.col("y0") + size))


def prefix_pairs(lines: Column) -> Column:
    """How many lines (of two characters or more) are a strict prefix of another."""
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.length(x) >= 2)
    return F.transform(F.array(kept), lambda ls: F.size(F.filter(ls, lambda a: F.exists(ls, lambda b: (F.length(a) < F.length(b)) & b.startswith(a)))))[0]


def confidence(text: Column, mean_score: Column, tiled: Column, pairs: Column, min_side: Column, error: Column, too_small: Column) -> Column:
    """ok, low, no_text or unknown."""
    some = F.trim(text) != ""
    return (
        F.when(too_small, "unknown")
        .when(error, "no_text")
        .when(some & tiled & (pairs >= 2), "low")
        .when(some & (mean_score < LOW_SCORE), "low")
        .when(some & mean_score.isNotNull(), "ok")
        .when(~some & (min_side >= LARGE_SIDE), "no_text")
        .otherwise("unknown")
    )


def in_cells(boxes: DataFrame, lanes: DataFrame, bands: DataFrame, image: str) -> DataFrame:
    """Boxes (cx, cy) with the lane and the band that hold their middle: equal joins on the image, ranges inside it."""
    x = boxes.join(lanes.withColumnRenamed(image, "_image"), (F.col(image) == F.col("_image")) & (F.col("cx") >= F.col("x0")) & (F.col("cx") < F.col("x1"))).drop("_image")
    return x.join(bands.withColumnRenamed(image, "_image"), (F.col(image) == F.col("_image")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") < F.col("y1"))).drop("_image")


def drop_contained(boxes: DataFrame, image: str, gap: float = 10.0, inside: float = 2.0) -> DataFrame:
    """Boxes without the fragments of longer texts that they overlap by half of their height or more.

    A fragment lies inside the longer box and is part of its text, or touches its right edge and is the end of its
    text, or its left edge and is the start.
    """
    other = boxes.select(*(F.col(c).alias(f"o_{c}") for c in boxes.columns))
    mine, theirs = F.trim(F.col("text")), F.trim(F.col("o_text"))
    overlap = F.least(F.col("y") + F.col("h"), F.col("o_y") + F.col("o_h")) - F.greatest("y", "o_y")
    right, o_right = F.col("x") + F.col("w"), F.col("o_x") + F.col("o_w")
    ends = F.abs(F.col("x") - o_right).between(0, gap) & F.endswith(theirs, mine)
    starts = F.abs(right - F.col("o_x")).between(0, gap) & F.startswith(theirs, mine)
    within = (F.col("x") >= F.col("o_x") - inside) & (right <= o_right + inside) & F.contains(theirs, mine)
    on = (F.col(image) == F.col(f"o_{image}")) & (mine != "") & (F.length(mine) < F.length(theirs)) & (overlap >= 0.5 * F.least("h", "o_h")) & (ends | starts | within)
    return boxes.join(other, on, "left_anti")
