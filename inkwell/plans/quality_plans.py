"""Quality scores of documents and their rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.quality import with_quality
from inkwell.operators.aggregates import upper_median
from inkwell.sources.tables import spread, table

COLUMNS = ["doc_id", "score", "completeness", "structure", "formatting", "cleanliness", "char_count", "line_count", "heading_count", "table_count", "list_item_count", "warnings"]
# Literals are Python strings so that line ends reach SQL as characters.
_SCORED = r"""
t AS (SELECT *, coalesce(text, '') AS md FROM src),
f AS (SELECT *, CAST(length(trim(md, E' \t\n\r\x0b\x0c')) AS BIGINT) AS n,
  CAST(length(translate(md, E'#*|-[]>`~\n\r\t ', '')) AS BIGINT) AS substance,
  list_transform(regexp_extract_all(md, '(?m)^(#{1,6})\s+(.+)$', 1), lambda x: length(x)) AS levels,
  len(list_filter(regexp_extract_all(md, '(?m)^(#{1,6})\s+(.+)$', 2), lambda x: trim(x, E' \t\n\r') = '')) AS empty_headings,
  length(md) - length(replace(md, chr(10), '')) + 1 AS lines,
  list_transform(regexp_extract_all(md, '(?m)^\|.+\|$'), lambda r: length(r) - length(replace(r, '|', '')) - 1) AS widths,
  len(regexp_extract_all(md, '(?m)^\|[\s\-:|]+\|$')) AS seps,
  len(regexp_extract_all(md, '(?m)^```')) AS fences,
  len(regexp_extract_all(md, '(?m)\[[^\]]*\]\([^)]*$')) AS broken,
  len(regexp_extract_all(md, '(?m)^[\-\*]\S')) AS bullets,
  length(md) - length(replace(md, chr(65533), '')) AS odd,
  len(regexp_extract_all(md, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) AS controls,
  len(regexp_extract_all(md, '\n{5,}')) AS blanks,
  len(regexp_extract_all(md, '(?m)[ \t]+$')) AS n_trailing,
  len(regexp_extract_all(md, '<[a-zA-Z][^>]*>')) - len(regexp_extract_all(md, '<br\s*/?>')) AS tags,
  len(regexp_extract_all(md, '(?m)^#{1,6}\s')) AS headings,
  len(regexp_extract_all(md, '(?m)^[\-\*\d]+[.)]\s')) AS items FROM t),
p AS (SELECT *,
  CASE WHEN n = 0 THEN 0 WHEN n < 10 THEN 10 ELSE greatest(0, least(100, 100 - CASE WHEN n < 50 THEN 30 ELSE 0 END - CASE WHEN substance < n * 0.3 THEN 20 ELSE 0 END)) END AS completeness,
  CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(100, 100 - CASE WHEN len(levels) = 0 THEN 30 ELSE 5 * len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] > levels[i - 1] + 1)) END - 10 * empty_headings
    - CASE WHEN NOT contains(md, chr(10) || chr(10)) AND lines > 5 THEN 20 ELSE 0 END - CASE WHEN len(widths) > 0 AND seps = 0 THEN 15 ELSE 0 END)) END AS structure,
  CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(100, 100 - CASE WHEN len(widths) = 0 THEN 0 ELSE least(30, 5 * (len(widths) - list_max(list_transform(list_distinct(widths), lambda w: len(list_filter(widths, lambda x: x = w)))))) END
    - CASE WHEN fences % 2 <> 0 THEN 20 ELSE 0 END - 10 * broken - least(15, 3 * bullets))) END AS formatting,
  CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(100, 100 - least(40, 5 * odd) - least(30, 3 * controls) - least(20, 5 * blanks) - CASE WHEN n_trailing / lines > 0.3 THEN 15 ELSE 0 END - least(20, 2 * tags))) END AS cleanliness FROM f),
scored AS (SELECT * EXCLUDE (completeness, structure, formatting, cleanliness), CAST(completeness AS INTEGER) AS completeness, CAST(structure AS INTEGER) AS structure, CAST(formatting AS INTEGER) AS formatting, CAST(cleanliness AS INTEGER) AS cleanliness,
  CAST(round_even(CAST(7 * completeness + 5 * structure + 4 * formatting + 4 * cleanliness AS DECIMAL(10, 2)) / CAST(20 AS DECIMAL(10, 2)), 1) AS DOUBLE) AS score,
  CAST(length(md) AS BIGINT) AS char_count, CAST(lines AS BIGINT) AS line_count, CAST(headings AS BIGINT) AS heading_count, CAST(len(widths) AS BIGINT) AS table_count, CAST(items AS BIGINT) AS list_item_count,
  array_to_string(list_filter([CASE WHEN n = 0 THEN 'Empty output' END, CASE WHEN n > 0 AND completeness < 50 THEN 'Low completeness: output may be truncated or sparse' END,
    CASE WHEN n > 0 AND structure < 50 THEN 'Poor structure: missing headings or paragraph separation' END,
    CASE WHEN n > 0 AND cleanliness < 50 THEN 'Low cleanliness: garbled text or excessive whitespace detected' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM p)
"""
SCORED = "WITH src AS (SELECT * FROM documents)," + _SCORED
#: Markdown with headings, tables, links, fences and debris, made of the orders' columns.
SYNTHETIC = r"""
SELECT o_orderkey AS doc_id, concat(
  CASE WHEN o_orderkey % 3 = 0 THEN concat('# Order ', CAST(o_orderkey AS VARCHAR), chr(10)) ELSE '' END,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('### ', o_orderpriority, chr(10), chr(10)) ELSE '' END,
  CASE WHEN o_orderkey % 5 < 2 THEN concat('| a | b |', chr(10), CASE WHEN o_orderkey % 2 = 0 THEN concat('|---|---|', chr(10)) ELSE '' END, '| ', o_orderstatus, ' | x | y |', chr(10)) ELSE '' END,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('```', chr(10)) ELSE '' END,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('[link](broken', chr(10), '-bad', chr(10), '<div class="x">', chr(10), '<br/>', chr(10)) ELSE '' END,
  CASE WHEN o_orderkey % 9 = 0 THEN concat('tail   ', chr(10), chr(10), chr(10), chr(10), chr(10), chr(10), chr(7), '�') ELSE '' END,
  o_orderpriority, ' 1. text ', CASE WHEN o_orderkey % 11 = 0 THEN repeat('*', 60) ELSE 'of the order' END) AS text FROM orders
"""
SCRAPS = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ab' WHEN 2 THEN concat(repeat(chr(7), 20), repeat(concat('[x](', chr(10), '-b', chr(10)), 20), repeat('<i>', 9)) ELSE o_orderpriority END AS text FROM orders"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(spread(table(spark, sf_dir, "documents")))


def quality_score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(*COLUMNS)


def quality_synthetic_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.sql(SYNTHETIC.replace("VARCHAR", "STRING").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return with_quality(made).select(*COLUMNS)


def quality_source_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores where the source is a page: its html's bytes, against the text between its tags."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("size"), F.regexp_replace("html", "<[^>]*>", "").alias("text"))
    return with_quality(pages, source_size=F.col("size")).select("page_id", "score", "completeness")


def quality_rollup(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum((10 * F.col("score")).cast("decimal(12,0)")).cast("long").alias("tenths"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.sum((F.col("score") < 50).cast("long")).alias("n_low")
    )


def quality_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upper_median("score", ["source"], scored(spark, sf_dir)).withColumnRenamed("median", "median_score")


def quality_low_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that score below 50: here empty ones, scraps, debris, and short texts."""
    made = spark.sql(SCRAPS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return with_quality(made).filter("score < 50").select("doc_id", "score", "warnings")


_ROLLUP = SCORED + " SELECT {by}, count(*) AS n, CAST(sum(CAST(10 * score AS DECIMAL(12, 0))) AS BIGINT) AS tenths, min(score) AS min_score, max(score) AS max_score, CAST(sum(CASE WHEN score < 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_low FROM scored GROUP BY {by}"

QUERIES = {
    "quality_score_documents": (quality_score_documents, f"{SCORED} SELECT {', '.join(COLUMNS)} FROM scored"),
    "quality_synthetic_markdown": (quality_synthetic_markdown, f"WITH src AS ({SYNTHETIC}), {_SCORED} SELECT {', '.join(COLUMNS)} FROM scored"),
    "quality_source_size": (
        quality_source_size,
        "WITH src AS (SELECT page_id, strlen(html) AS size, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages),"
        + _SCORED.replace("THEN 20 ELSE 0 END)) END AS completeness", "THEN 20 ELSE 0 END - CASE WHEN size <= 0 THEN 0 WHEN n / size < 0.01 THEN 40 WHEN n / size < 0.05 THEN 20 WHEN n / size > 10 THEN 10 ELSE 0 END)) END AS completeness")
        + " SELECT page_id, score, completeness FROM scored",
    ),
    "quality_rollup_by_lang": (lambda s, d: quality_rollup(s, d, "lang"), _ROLLUP.replace("{by}", "lang")),
    "quality_rollup_by_source": (lambda s, d: quality_rollup(s, d, "source"), _ROLLUP.replace("{by}", "source")),
    "quality_upper_median_by_source": (quality_upper_median, SCORED + " SELECT source, list_sort(list(score))[count(*) // 2 + 1] AS median_score FROM scored GROUP BY source"),
    "quality_low_files": (quality_low_files, f"WITH src AS ({SCRAPS}), {_SCORED} SELECT doc_id, score, warnings FROM scored WHERE score < 50"),
}
