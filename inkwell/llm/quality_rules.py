"""Operator 4: quality rules over a text's own words and over the lines that a host's documents share.

Native: DataFrame functions only. A line is normalised (lower case, digits as 0, one space between words) and
hashed with its host; a line that more than `min_docs` different texts of that host hold is removed, however many
texts the host has, and a document with less than `min_left` of its words left is rejected.

Defined results: null text counts as empty; a null source is a host of its own; copies of a text on a host
count as one document, so that a group of copies does not turn its own lines into boilerplate; repeated rows get
one row each, alike; an empty table gives an empty result; further columns of the input are carried by
`filter_documents` and left aside by `score_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, row_of, stash, table, text_key, with_text, words_of

MIN_DOCS = 10
MIN_LEFT = 0.3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Frequent lines up to which they are sent to all executors (about 60 bytes each); beyond, the join shuffles over SALTS keys a line.
SEND_ROWS = 200_000
SALTS = 32


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _normal(line: Column) -> Column:
    flat = F.translate(F.lower(line), "\t\x0b\x0c\r123456789", "    000000000")
    return F.array_join(F.array_remove(F.split(flat, " "), ""), " ")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: where hashes repeat, sort them with their places, keep those with an equal neighbour."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def repeated(s: Column) -> Column:
        at = lambda i: F.get(s, i)["h"]
        same = F.transform(s, lambda x, i: F.when((at(i - 1) == x["h"]) | (at(i + 1) == x["h"]), x["i"]))
        return F.sort_array(F.filter(same, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(placed, repeated), covered))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), counted))


def base_columns(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id, host, key of the text and the base columns; with row, also the struct _row of all columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = lambda w: F.length(F.array_join(w, "")).cast("long")
    facts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"), chars(w).alias("c")))
    dup = let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    whole = [row_of(docs).alias("_row")] if row else []
    read = docs.select(
        "doc_id",
        *whole,
        F.col("source").alias("_host"),
        text_key(text).alias("_key"),
        facts.alias("_facts"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"),
    )
    n, r = F.col("_facts.n"), F.col("_facts.r")
    failed = (n < 50) | (100 * r > 50 * n)
    facts_of = [n.alias("n_words"), F.col("_facts.c").alias("word_chars"), "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), failed.alias("base_failed")]
    return read.select("doc_id", *(["_row"] if row else []), "_host", "_key", *facts_of)


def removed_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """_host, _key and, for texts with lines above the limit, their hashes and the words in them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.transform(
        _lines(text), lambda x: let(_normal(x), lambda n: F.struct(F.xxhash64(n).alias("line"), F.size(F.split(n, " ")).alias("words")))
    )
    by_text = stash(
        docs.select(F.col("source").alias("_host"), text_key(text).alias("_key"), F.explode(hashed).alias("x"))
        .select("_host", "_key", "x.line", "x.words")
        .groupBy("_host", "_key", "line")
        .agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("n")),
        "lines",
    )  # read twice: for the counts, and for the lines above the limit
    often = by_text.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > min_docs)
    often = stash(often.select(F.col("_host").alias("_of"), F.col("line").alias("_line")), "often")
    same = (F.col("line") == F.col("_line")) & F.col("_host").eqNullSafe(F.col("_of"))
    if often.count() <= SEND_ROWS:
        hit = by_text.join(F.broadcast(often), same).drop("_of")
    else:  # a line of a third of all texts is dealt to SALTS tasks
        salted = often.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = by_text.withColumn("salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
        hit = dealt.join(salted, same & (F.col("salt") == F.col("_salt"))).drop("_of", "salt", "_salt")
    gone = hit.groupBy("_host", "_key").agg(F.collect_list("line").alias("_often"), F.sum(F.col("words") * F.col("n")).alias("_all"))
    # copies of a text have put each of its lines there as often
    texts = docs.select(F.col("source").alias("_of"), text_key(text).alias("_text")).groupBy("_of", "_text").agg(F.count(F.lit(1)).alias("copies"))
    gone = gone.join(texts, (F.col("_key") == F.col("_text")) & F.col("_host").eqNullSafe(F.col("_of")))
    return gone.select("_host", "_key", "_often", F.expr("_all div copies").alias("_gone"))


def score_documents(docs: DataFrame, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    base = base_columns(docs)
    gone = removed_lines(docs, min_docs).select(F.col("_host").alias("_of"), F.col("_key").alias("_text"), F.col("_gone"))
    joined = base.join(gone, (F.col("_key") == F.col("_text")) & F.col("_host").eqNullSafe(F.col("_of")), "left")
    n_often = F.coalesce(F.col("_gone"), F.lit(0).cast("long"))
    depleted = F.col("n_words") - n_often < F.lit(min_left) * F.col("n_words")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"),
        n_often.alias("n_frequent_words"),
    )


def filter_documents(docs: DataFrame, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that the rules keep, without the lines above the limits; columns as in docs."""
    base = base_columns(docs, row=True)
    gone = removed_lines(docs, min_docs).select(F.col("_host").alias("_of"), F.col("_key").alias("_text"), "_often", "_gone")
    joined = base.join(gone, (F.col("_key") == F.col("_text")) & F.col("_host").eqNullSafe(F.col("_of")), "left")
    left = F.col("n_words") - F.coalesce(F.col("_gone"), F.lit(0).cast("long"))
    text = F.col("_row.text")
    rest = F.filter(
        F.split(text, "\n", -1), lambda x: (F.btrim(x, F.lit(SPACES)) == "") | ~F.array_contains(F.col("_often"), F.xxhash64(_normal(x)))
    )
    cleaned = F.when(F.col("_often").isNull(), text).otherwise(F.array_join(rest, "\n"))
    # one condition on both sides: a filter on base_failed alone would be pushed below, where its counts are made again
    kept = joined.filter(F.when(F.col("base_failed"), False).otherwise(left >= F.lit(min_left) * F.col("n_words")))
    return kept.select(*with_text(F.col("_row"), docs.columns, cleaned))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
wins AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
reps AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM reps, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
raw AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT rid, source, text, line, regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS norm
       FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY rid),
often AS (SELECT source, norm FROM ln GROUP BY source, norm
          HAVING count(DISTINCT text) > {MIN_DOCS}),
gone AS (SELECT rid, sum(len(string_split(norm, ' '))) AS n FROM ln WHERE EXISTS (SELECT 1 FROM often o WHERE o.norm = ln.norm AND o.source IS NOT DISTINCT FROM ln.source) GROUP BY rid),
base AS (SELECT d.rid, d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_frequent_words
         FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_frequent_words >= {MIN_LEFT} * n_words AS kept, n_frequent_words FROM f
"""
