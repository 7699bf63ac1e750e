"""Order-dependent box rules, a group (image) at a time: greedy duplicates, reading order, lines by gap, swim lanes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How near equal texts are one, and the shape of a swim-lane chart.
NEAR_X, NEAR_Y = 24, 12
BOX_GAP = 1.6
AXIS_OF_MEDIAN, AXIS_OF_WIDTH, LANE_COVERED, TALL = 0.55, 0.35, 0.3, 1.15
CJK = r"[\u3000-\u9FFF\uF900-\uFAFF\uFF00-\uFFEF]"


def drop_near(boxes: DataFrame, image: str) -> DataFrame:
    """The first of boxes with equal text and nearly equal place stays, in the order of `box`.

    Only boxes of one image and text can be near, so that is the group: it is folded in one row, in order.
    """
    items = boxes.groupBy(image, "text").agg(F.array_sort(F.collect_list(F.struct("box", "x", "y"))).alias("b"))

    def step(kept, b):
        near = F.exists(kept, lambda k: (F.abs(k["x"] - b["x"]) <= NEAR_X) & (F.abs(k["y"] - b["y"]) <= NEAR_Y))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(b)))

    kind = items.schema["b"].dataType.simpleString()
    return items.select(image, F.explode(F.aggregate("b", F.array().cast(kind), step)).alias("k")).select(image, F.col("k.box").alias("box"))


def reading_order(boxes: DataFrame, image: str) -> DataFrame:
    """boxes with line and place: a box joins the line whose first box it overlaps by more than half of the lower height, else starts one; lines go down, boxes right."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x", "box"], kind="stable")
        lines: list[tuple[float, float, list[int]]] = []
        for i, (y, h) in enumerate(zip(pdf["y"], pdf["h"], strict=True)):
            home = next((q for q in lines if min(y + h, q[0] + q[1]) - max(y, q[0]) > 0.5 * min(h, q[1])), None)
            if home is None:
                home = (y, h, [])
                lines.append(home)
            home[2].append(i)
        line = {i: k for k, (_, _, members) in enumerate(sorted(lines, key=lambda q: q[0])) for i in members}
        pdf = pdf.assign(line=[line[i] for i in range(len(pdf))]).sort_values(["line", "x", "box"], kind="stable")
        return pdf.assign(place=range(len(pdf)))[[image, "box", "line", "place"]]

    return boxes.select(image, "box", "x", "y", "h").groupBy(image).applyInPandas(order, f"{image} long, box long, line long, place long")


def lanes(lines: DataFrame, image: str, min_share: float = 0.6, min_lines: int = 4) -> DataFrame:
    """Vertical lines (x, y0, y1, height of the image) that cover enough of it, as lanes between neighbours, of images with enough of them."""
    from pyspark.sql import Window

    w = Window.partitionBy(image)
    tall = lines.filter((F.col("y1") - F.col("y0")) >= min_share * F.col("height")).withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") >= min_lines)
    nxt = F.lead("x").over(w.orderBy("x"))
    return tall.withColumn("x1", nxt).filter(F.col("x1").isNotNull()).select(image, F.col("x").alias("x0"), "x1", F.row_number().over(Window.partitionBy(image).orderBy("x")).alias("lane"))


def grouped_by_gap(boxes: DataFrame, cell: str, median_height: int) -> DataFrame:
    """Boxes of a cell, top down, joined to one text while the gap is small; a larger one is a line break."""
    from pyspark.sql import Window

    w = Window.partitionBy(cell).orderBy("y", "box")
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(w)
    sep = F.when(gap.isNull(), "").when(gap <= BOX_GAP * median_height, "").otherwise("<br>")
    parts = boxes.withColumn("_part", F.concat(sep, "text")).groupBy(cell).agg(F.array_sort(F.collect_list(F.struct("y", "box", "_part"))).alias("p"))
    return parts.select(cell, F.array_join(F.transform("p", lambda s: s["_part"]), "").alias("text"))


def joined_texts(texts: Column) -> Column:
    """Trimmed texts on end, with a blank but between two CJK characters; empty ones are left out."""

    def add(done: Column, t: Column) -> Column:
        both = done.rlike(f"{CJK}$") & t.rlike(f"^{CJK}")
        return F.when(t == "", done).when((done == "") | both, F.concat(done, t)).otherwise(F.concat(done, F.lit(" "), t))

    return F.aggregate(texts, F.lit(""), lambda a, t: add(a, F.trim(t)))


def cell_text(found: Column) -> Column:
    """Boxes (y, x, h, text) of a cell as one text: those that follow each other closely are one box's lines, others are set apart by <br>."""
    boxes = F.array_sort(found)
    heights = F.array_sort(F.transform(boxes, lambda b: F.greatest(F.lit(1.0), b["h"].cast("double"))))
    n = F.size(heights)
    median = (F.get(heights, F.floor((n - 1) / 2).cast("int")) + F.get(heights, F.floor(n / 2).cast("int"))) / 2
    start = F.struct(F.lit(None).cast("double").alias("end"), F.array().cast("array<array<string>>").alias("groups"))

    def step(a: Column, b: Column) -> Column:
        near = a["end"].isNotNull() & (b["y"] - a["end"] <= BOX_GAP * median)
        last = F.element_at(a["groups"], -1)
        more = F.concat(F.slice(a["groups"], F.lit(1), F.size(a["groups"]) - 1), F.array(F.concat(last, F.array(b["text"]))))
        end = (b["y"] + b["h"]).cast("double")
        # the lowest edge of the group so far
        return F.struct(F.when(near, F.greatest(a["end"], end)).otherwise(end).alias("end"), F.when(near, more).otherwise(F.concat(a["groups"], F.array(F.array(b["text"])))).alias("groups"))

    return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.aggregate(boxes, start, step)["groups"], joined_texts), "<br>"))


def swim_lanes(images: DataFrame, uprights: DataFrame, levels: DataFrame, boxes: DataFrame) -> DataFrame:
    """image, title, lanes (names) and rows (label, cells) of the images that are swim lane charts.

    images: image, width; uprights: image, x of the lines that cover most of its height; levels: image, y, x0, x1, the
    pieces of level lines; boxes: image, x, y, w, h, text. The first band between uprights must be the narrow axis of
    the phases' names, which stand upright in it; a level line counts if it covers enough of every lane. The band above
    the first phase holds the lanes' names, and what is above that is the title. Images are small, so that each is a
    group; bands, lanes and boxes meet on the image.
    """
    near = lambda df, *c: df.select(F.col("image").alias("_i"), *c)
    xs = uprights.groupBy("image").agg(F.array_sort(F.collect_set(F.col("x").cast("double"))).alias("xs")).filter(F.size("xs") >= 4)
    widths = F.array_sort(F.transform(F.sequence(F.lit(1), F.size("xs") - 1), lambda i: F.get(F.col("xs"), i) - F.get(F.col("xs"), i - 1)))
    n = F.size("xs") - 1
    framed = xs.join(near(images, "width"), F.col("image") == F.col("_i")).withColumn("_w", widths)
    median = (F.get("_w", F.floor((n - 1) / 2).cast("int")) + F.get("_w", F.floor(n / 2).cast("int"))) / 2
    first = F.get("xs", F.lit(1)) - F.get("xs", F.lit(0))
    framed = framed.filter((first < AXIS_OF_MEDIAN * median) & (first < AXIS_OF_WIDTH * F.col("width"))).select("image", "xs")
    lanes_of = framed.select("image", F.posexplode(F.slice("xs", F.lit(2), F.size("xs") - 2)).alias("lane", "lane0"), "xs").select("image", "lane", "lane0", F.get("xs", F.col("lane") + 2).alias("lane1"))

    pieces = levels.join(near(lanes_of, "lane", "lane0", "lane1"), F.col("image") == F.col("_i"))
    covered = F.sum(F.greatest(F.lit(0.0), F.least(F.col("x1").cast("double"), F.col("lane1")) - F.greatest(F.col("x0").cast("double"), F.col("lane0")))) / F.first(F.col("lane1") - F.col("lane0"))
    lines = pieces.groupBy("image", "y", "lane").agg(covered.alias("share")).groupBy("image", "y").agg(F.min("share").alias("least")).filter(F.col("least") >= LANE_COVERED)
    bands = lines.groupBy("image").agg(F.array_sort(F.collect_set(F.col("y").cast("double"))).alias("ys")).filter(F.size("ys") >= 3)
    bands = bands.select("image", F.posexplode(F.slice("ys", F.lit(1), F.size("ys") - 1)).alias("band", "y0"), "ys").select("image", "band", "y0", F.get("ys", F.col("band") + 1).alias("y1"))

    own = boxes.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    placed = own.join(near(bands, "band", "y0", "y1"), (F.col("image") == F.col("_i")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") < F.col("y1"))).drop("_i", "y0", "y1")
    axis = framed.select(F.col("image").alias("_i"), F.get("xs", F.lit(0)).alias("a0"), F.get("xs", F.lit(1)).alias("a1"))
    names = placed.join(axis, (F.col("image") == F.col("_i")) & (F.col("cx") >= F.col("a0")) & (F.col("cx") < F.col("a1"))).filter(F.col("h") > TALL * F.greatest(F.lit(1), F.col("w")))
    texts = lambda order: F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda s: s["text"])
    phases = names.groupBy("image", "band").agg(joined_texts(texts(["y"])).alias("label"))
    head = phases.groupBy("image").agg((F.min("band") - 1).alias("head"), F.count(F.lit(1)).alias("_n")).filter("_n >= 2 AND head >= 0").select(F.col("image").alias("_h"), "head")

    held = placed.join(near(lanes_of, "lane", "lane0", "lane1"), (F.col("image") == F.col("_i")) & (F.col("cx") >= F.col("lane0")) & (F.col("cx") < F.col("lane1")))
    cells = held.groupBy("image", "band", "lane").agg(F.collect_list(F.struct("y", "x", "h", "text")).alias("found"))
    grid = lanes_of.join(head, F.col("image") == F.col("_h")).join(near(bands, "band"), F.col("image") == F.col("_i")).select("image", "head", "band", "lane")
    own = cells.select(F.col("image").alias("_i"), F.col("band").alias("_b"), F.col("lane").alias("_l"), "found")
    full = grid.join(own, (F.col("image") == F.col("_i")) & (F.col("band") == F.col("_b")) & (F.col("lane") == F.col("_l")), "left")
    empty = F.array().cast(cells.schema["found"].dataType)
    found = F.array_sort(F.coalesce("found", empty))
    plain = joined_texts(F.transform(found, lambda b: b["text"]))
    text = F.when(F.col("band") == F.col("head"), plain).otherwise(cell_text(found))
    by_band = full.select("image", "head", "band", "lane", text.alias("t")).groupBy("image", "head", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("lane", "t"))), lambda s: s["t"]).alias("cells"))
    label = phases.select(F.col("image").alias("_i"), F.col("band").alias("_b"), "label")
    rows = by_band.join(label, (F.col("image") == F.col("_i")) & (F.col("band") == F.col("_b")), "left")
    body = (F.col("label") != "") & F.exists("cells", lambda c: c != "")
    chart = rows.groupBy("image").agg(
        F.max(F.when(F.col("band") == F.col("head"), F.col("cells"))).alias("lanes"),
        F.array_sort(F.collect_list(F.when(body, F.struct("band", "label", "cells")))).alias("_rows"),
    )
    above = placed.join(head, F.col("image") == F.col("_h")).filter(F.col("band") < F.col("head")).groupBy(F.col("image").alias("_t")).agg(joined_texts(texts(["y", "x"])).alias("title"))
    done = chart.filter(F.size("_rows") >= 2).join(above, F.col("image") == F.col("_t"), "left")
    return done.select("image", F.coalesce("title", F.lit("")).alias("title"), "lanes", F.transform("_rows", lambda r: F.struct(r["label"].alias("label"), r["cells"].alias("cells"))).alias("rows"))
