"""Blocks to Markdown, as Catalyst expressions over arrays of blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import let, strip
from .text import escape_cell, squeeze


def table_markdown(rows: Column) -> Column:
    """Cells escaped, empty cells at the end of a row left out, empty rows skipped, a separator after the first row."""

    def filled(row: Column) -> Column:
        cells = F.transform(row, escape_cell)
        last = let(cells, lambda c: F.array_max(F.transform(c, lambda x, i: F.when(x != "", i + 1).otherwise(0))))
        return F.slice(cells, 1, F.coalesce(last, F.lit(0)))

    def line(c: Column, i: Column) -> Column:
        text = F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
        rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.size(c)), " | "), F.lit(" |"))
        return F.when(F.size(c) == 0, F.lit(None)).otherwise(F.concat(text, F.when(i == 0, rule).otherwise("")))

    lines = F.array_compact(F.transform(F.transform(rows, filled), line))
    return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")))


def block_markdown(b: Column) -> Column:
    head = F.concat(F.lit("\n"), F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"], F.lit("\n"))
    quote = F.concat(F.lit("\n> "), F.replace(b["text"], F.lit("\n"), F.lit("\n> ")), F.lit("\n"))
    item = F.when(b["text"].rlike(r"^\d+\. "), b["text"]).otherwise(F.concat(F.lit("- "), b["text"]))
    item = F.concat(F.repeat(F.lit("  "), b["level"]), item)
    code = F.concat(F.lit("\n```\n"), b["text"], F.lit("\n```\n"))
    return F.when(b["kind"] == "h", head).when(b["kind"] == "quote", quote).when(b["kind"] == "li", item).when(b["kind"] == "table", table_markdown(b["rows"])).when(b["kind"] == "code", code).when(b["kind"] == "hr", "\n---\n").otherwise(b["text"])


def inlines_markdown(spans: Column) -> Column:
    """Spans (kind, text, url, title) of a paragraph: text, bold, italic, strike, code, link, image, note; notes are numbered by their first place."""
    title = lambda s: F.when(s["title"] != "", F.concat(F.lit(' "'), s["title"], F.lit('"'))).otherwise("")
    around = lambda s, mark: F.concat(F.lit(mark), s["text"], F.lit(mark))
    notes = F.array_distinct(F.transform(F.filter(spans, lambda s: s["kind"] == "note"), lambda s: s["text"]))

    def one(s: Column) -> Column:
        return (
            F.when(s["kind"] == "bold", around(s, "**"))
            .when(s["kind"] == "italic", around(s, "*"))
            .when(s["kind"] == "strike", around(s, "~~"))
            .when(s["kind"] == "code", around(s, "`"))
            .when(s["kind"] == "link", F.concat(F.lit("["), s["text"], F.lit("]("), s["url"], title(s), F.lit(")")))
            .when(s["kind"] == "image", F.concat(F.lit("!["), s["text"], F.lit("]("), s["url"], title(s), F.lit(")")))
            .when(s["kind"] == "note", F.concat(F.lit("[^"), F.array_position(notes, s["text"]).cast("string"), F.lit("]")))
            .otherwise(s["text"])
        )

    return F.array_join(F.transform(spans, one), "")


def document_markdown(blocks: Column, title: Column | None = None) -> Column:
    parts = F.transform(blocks, block_markdown)
    if title is not None:
        parts = F.concat(F.array(F.concat(F.lit("# "), title, F.lit("\n"))), parts)
    return strip(squeeze(F.array_join(parts, "\n"), 4, 3))


def lanes_markdown(title: Column, lanes: Column, rows: Column) -> Column:
    """A swim lane diagram as a table: rows (label, cells) are phases, columns are lanes; nothing where no lane has a name."""
    head = F.concat(F.lit("| 阶段 \\ 部门 | "), F.array_join(F.transform(lanes, lambda x: F.when(x == "", "—").otherwise(x)), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| --- |"), F.repeat(F.lit(" --- |"), F.size(lanes)))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| **"), r["label"], F.lit("** | "), F.array_join(r["cells"], " | "), F.lit(" |")))
    table = F.array_join(F.concat(F.array(head, rule), lines), "\n")
    named = F.when(title != "", F.concat(F.lit("**"), title, F.lit("**\n\n"))).otherwise("")
    return F.when(F.exists(lanes, lambda x: x != ""), F.concat(named, F.lit("[图形结构：泳道图还原为下表，行=阶段，列=部门]\n\n"), table)).otherwise("")


def table_shape(rows: Column) -> Column:
    """columns and empty of a table's rows (arrays of text, colspan): the widest row's spans, and whether no cell has text."""
    widths = F.transform(rows, lambda r: F.aggregate(F.transform(r, lambda c: c["colspan"]), F.lit(0), lambda a, x: a + x))
    empty = F.forall(rows, lambda r: F.forall(r, lambda c: strip(c["text"]) == ""))
    return F.struct(F.coalesce(F.array_max(widths), F.lit(0)).alias("columns"), empty.alias("empty"))


def page_markdown(title: Column, bodies: Column, gone: Column, head: Column) -> Column:
    """A page of a book: the bodies of its sources between rules, a title where there is none, a banner on what is void, front matter before all."""
    filled = F.filter(F.transform(bodies, strip), lambda b: b != "")

    def made(body: Column) -> Column:
        titled = F.when(body == "", "（本条目对应的 HTML 内容为空或无法解析）").when(body.startswith("# "), body).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), body))
        banner = F.when(gone, F.lit("> ⚠️ **本文档已废止**，仅为历史留存，请勿作为现行依据。\n\n")).otherwise("")
        return F.concat(head, banner, titled)

    return let(F.array_join(filled, "\n\n---\n\n"), made)
