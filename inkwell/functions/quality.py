"""Rule scores of Markdown texts, as Catalyst expressions.

Java patterns carry the flags m and d: ^ and $ match at line ends, and only \\n ends a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and weights of the score.
HEADING = r"(?md)^(#{1,6})\s+(.+)$"
TABLE_LINE = r"(?md)^\|.+\|$"
SEPARATOR = r"(?md)^\|[\s\-:|]+\|$"
FENCE = r"(?md)^```"
BROKEN_LINK = r"(?md)\[[^\]]*\]\([^)]*$"
BAD_BULLET = r"(?md)^[\-\*]\S"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
BLANK_RUN = r"\n{5,}"
TRAILING = r"(?md)[ \t]+$"
TAG = r"<(?!br\s*/?>)(?!/br)[a-zA-Z][^>]*>"
LIST_ITEM = r"(?md)^[\-\*\d]+[.)]\s"
MARKUP = "#*|-[]>`~\n\r\t "
MARKUP_RUN = r"[#*|\-\[\]>`~\n\r\t ]+"
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_of(text: Column, c: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def completeness(text: Column, source_size: Column | None = None) -> Column:
    n = F.length(strip(text))
    score = F.lit(100) - F.when(n < 50, 30).otherwise(0)
    if source_size is not None:
        ratio = n / source_size
        off = F.when(ratio < 0.01, 40).when(ratio < 0.05, 20).when(ratio > 10, 10).otherwise(0)
        score = score - F.when(source_size > 0, off).otherwise(0)
    substance = F.length(F.regexp_replace(text, MARKUP_RUN, ""))
    score = score - F.when(substance < n * 0.3, 20).otherwise(0)
    return F.when(n == 0, 0).when(n < 10, 10).otherwise(_clamped(score))


def structure(text: Column) -> Column:
    def headed(levels: Column) -> Column:
        pairs = F.sequence(F.lit(1), F.size(levels) - 1)
        jumps = F.when(F.size(levels) < 2, 0).otherwise(F.size(F.filter(pairs, lambda i: F.length(F.get(levels, i)) > F.length(F.get(levels, i - 1)) + 1)))
        return F.when(F.size(levels) == 0, 30).otherwise(5 * jumps)

    empty = F.size(F.filter(F.regexp_extract_all(text, F.lit(HEADING), F.lit(2)), lambda t: strip(t) == ""))
    lines = count_of(text, "\n") + 1
    score = F.lit(100) - let(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), headed) - 10 * empty
    score = score - F.when(~F.contains(text, F.lit("\n\n")) & (lines > 5), 20).otherwise(0)
    return _clamped(score - F.when((_count(text, TABLE_LINE) > 0) & (_count(text, SEPARATOR) == 0), 15).otherwise(0))


def formatting(text: Column) -> Column:
    def uneven(widths: Column) -> Column:
        modes = F.transform(F.array_distinct(widths), lambda w: F.size(F.filter(widths, lambda x: x == w)))
        return F.when(F.size(widths) == 0, 0).otherwise(F.least(F.lit(30), 5 * (F.size(widths) - F.array_max(modes))))

    rows = F.regexp_extract_all(text, F.lit(r"(?md)^(\|.+\|)$"), F.lit(1))
    widths = F.transform(rows, lambda r: count_of(r, "|") - 1)
    score = F.lit(100) - let(widths, uneven) - F.when(_count(text, FENCE) % 2 != 0, 20).otherwise(0)
    return _clamped(score - 10 * _count(text, BROKEN_LINK) - F.least(F.lit(15), 3 * _count(text, BAD_BULLET)))


def cleanliness(text: Column) -> Column:
    lines = count_of(text, "\n") + 1
    odd = count_of(text, "\ufffd")
    score = F.lit(100) - F.least(F.lit(40), 5 * odd) - F.least(F.lit(30), 3 * _count(text, CONTROL)) - F.least(F.lit(20), 5 * _count(text, BLANK_RUN))
    return _clamped(score - F.when(_count(text, TRAILING) / lines > 0.3, 15).otherwise(0) - F.least(F.lit(20), 2 * _count(text, TAG)))


def with_quality(df: DataFrame, text: str = "text", source_size: Column | None = None) -> DataFrame:
    """df with score, its four parts, counts, and warnings; blank texts score 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = strip(t) == ""
    parts = {"completeness": completeness(t, source_size), "structure": structure(t), "formatting": formatting(t), "cleanliness": cleanliness(t)}
    scored = df.withColumns({k: F.when(blank, 0).otherwise(v).cast("int") for k, v in parts.items()})
    total = F.expr("7 * completeness + 5 * structure + 4 * formatting + 4 * cleanliness")
    warnings = [
        F.when(blank, "Empty output"),
        F.when(~blank & (F.col("completeness") < 50), "Low completeness: output may be truncated or sparse"),
        F.when(~blank & (F.col("structure") < 50), "Poor structure: missing headings or paragraph separation"),
        F.when(~blank & (F.col("cleanliness") < 50), "Low cleanliness: garbled text or excessive whitespace detected"),
    ]
    return scored.withColumns(
        {
            "score": F.bround(total.cast("decimal(10,2)") / 20, 1).cast("double"),
            "char_count": F.length(t).cast("long"),
            "line_count": (count_of(t, "\n") + 1).cast("long"),
            "heading_count": _count(t, r"(?md)^#{1,6}\s").cast("long"),
            "table_count": _count(t, TABLE_LINE).cast("long"),
            "list_item_count": _count(t, LIST_ITEM).cast("long"),
            "warnings": F.array_join(F.array_compact(F.array(*warnings)), "; "),
        }
    )
