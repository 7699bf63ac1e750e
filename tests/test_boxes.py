"""Swim lane charts from lines and recognised boxes, and fragments at seams."""

from pyspark.sql import functions as F

from inkwell.functions.render import lanes_markdown
from inkwell.operators.boxes import joined_texts, swim_lanes
from inkwell.operators.geometry import drop_contained

UPRIGHTS, LEVELS = [10, 60, 260, 460, 660, 890], [20, 100, 300, 500, 680]


def chart(spark, uprights=UPRIGHTS, phases=True, title=False):
    """Three phases of four lanes, a connector over two lanes, dashed lines."""
    boxes = [(name, 110 + 200 * i, 50, 60, 20) for i, name in enumerate(["部门一", "部门二", "部门三", "部门四"])]
    boxes += [(t, 20, y, 20, 60) for t, y in (("阶段甲", 120), ("阶段乙", 320), ("阶段丙", 520))] if phases else []
    boxes += [("动作A", 100, 150, 60, 20), ("动作B", 105, 190, 60, 20), ("动作C", 300, 150, 60, 20), ("动作D", 100, 350, 60, 20), ("动作E", 100, 420, 60, 20), ("动作F", 500, 550, 60, 20)]
    levels = [(y, UPRIGHTS[0], UPRIGHTS[-1]) for y in LEVELS if y not in (300, 500)]
    levels += [(y, x, x + 14) for y in (300, 500) for x in range(10, 890, 22)] + [(200, 60, 460)]
    if title:
        levels.append((2, 10, 890))
        boxes.append(("流程 one", 400, 5, 60, 10))
    images = spark.createDataFrame([(1, 900)], "image long, width long")
    ups = spark.createDataFrame([(1, x) for x in uprights], "image long, x long")
    lines = spark.createDataFrame([(1, *x) for x in levels], "image long, y long, x0 long, x1 long")
    return swim_lanes(images, ups, lines, spark.createDataFrame([(1, x, y, w, h, t) for t, x, y, w, h in boxes], "image long, x long, y long, w long, h long, text string"))


def test_swim_lanes(spark):
    found = chart(spark).collect()
    assert len(found) == 1 and found[0].lanes == ["部门一", "部门二", "部门三", "部门四"] and found[0].title == ""
    rows = {r.label: r.cells for r in found[0].rows}
    assert list(rows) == ["阶段甲", "阶段乙", "阶段丙"]  # the connector is no line between rows, the dashed ones are
    assert rows["阶段甲"] == ["动作A 动作B", "动作C", "", ""] and rows["阶段乙"][0] == "动作D<br>动作E" and rows["阶段丙"][2] == "动作F"
    assert chart(spark, title=True).first().title == "流程 one"


def test_what_is_no_chart(spark):
    assert chart(spark, phases=False).count() == 0
    assert chart(spark, uprights=[10, 260, 460, 660, 890]).count() == 0  # no narrow axis
    assert chart(spark, uprights=[10, 60, 260]).count() == 0


def test_chart_as_markdown(spark):
    text = chart(spark).select(lanes_markdown(F.col("title"), F.col("lanes"), F.col("rows")).alias("m")).first().m
    assert text.splitlines()[-1] == "| **阶段丙** |  |  | 动作F |  |" and "| 阶段 \\ 部门 | 部门一 |" in text


def test_joined_texts(spark):
    rows = [(["中", "文", "a", "b", " ", "中"], "中文 a b 中"), ([], ""), (["", "x"], "x")]
    got = spark.createDataFrame(rows, "t array<string>, want string").select(joined_texts(F.col("t")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_fragments(spark):
    rows = [
        ("whole", 0, 0, 40, 20, "客户经理"), ("end", 45, 2, 10, 18, "理"), ("start", -12, 0, 10, 20, "客户"), ("inside", 10, 0, 20, 20, "户经"), ("other", 45, 0, 10, 20, "客"),
        ("far", 60, 0, 10, 20, "理"), ("below", 42, 15, 10, 20, "理"), ("empty", 41, 0, 5, 20, " "), ("same", 42, 200, 40, 20, "客户经理"), ("twin", 44, 202, 40, 20, "客户经理"),
    ]
    boxes = spark.createDataFrame([(1, *r) for r in rows], "image long, box string, x long, y long, w long, h long, text string")
    assert {r.box for r in drop_contained(boxes, "image").collect()} == {"whole", "other", "far", "below", "empty", "same", "twin"}
