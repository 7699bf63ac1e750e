"""Budgets, windows and top rows over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators import budgets
from inkwell.operators.aggregates import percent, score_gate, unjudged
from inkwell.sources.tables import table

ROWS, CELLS, CHARS = 200, 1500, 9000
SINGLE, TOTAL = 400, 700


def _micros(name: str) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def budget_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the rows of one sheet a supplier."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    chars = F.length(F.col("l_partkey").cast("string")) + 40
    out = budgets.within_budget(items, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], ROWS, CELLS, CHARS, F.lit(7), chars)
    return out.groupBy("l_suppkey").agg(F.sum(F.col("kept").cast("long")).alias("n_kept"), F.min_by("reason", F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("_first"), F.count(F.lit(1)).alias("n_all")).drop("_first")


def budget_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    out = budgets.within_budget(lines.filter("trim(line) <> ''"), ["doc_id"], ["at"], 8, 30, 1200, F.lit(2), F.length("line"))
    return out.groupBy("doc_id").agg(F.sum(F.col("kept").cast("long")).alias("n_kept"), F.min_by("reason", F.when(~F.col("kept"), F.col("at"))).alias("reason"))


def budget_greedy_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return budgets.greedy_budget(turns, "conv_id", "turn", "size", SINGLE, TOTAL)


def column_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.split("line", " ")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select("doc_id", F.col("at").cast("long").alias("at"), F.array_join(F.slice(cells, 1, 80), "|").alias("row"), (F.size(cells) > 80).alias("clamped"))


def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(_micros("ts") / 1_000_000).alias("sec"))
    out = budgets.islands(e, "user_id", F.col("sec"), F.lit(3600))
    return out.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))


def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return budgets.last_n(e, "event_type", [F.col("ts").desc(), F.col("event_id").desc()], 20).select("event_type", "event_id")


def round_robin_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return budgets.round_robin(d, "source", "doc_id", 50).select("source", "doc_id", F.col("turn").cast("long").alias("turn"))


def heading_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a level in a sequence exceeds the one before by more than one (part sizes as levels)."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 6 + 1).alias("level")).withColumn("before", F.lag("level").over(w))
    return p.filter("level > before + 1").groupBy("p_brand").agg(F.count(F.lit(1)).alias("jumps"))


def note_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes are numbered by their first reference."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("at"))
    return first.select("l_orderkey", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("at", "l_partkey")).cast("long").alias("note"))


def list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + F.col("o_custkey") % 5
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(k.cast("string"), F.lit(". "), "o_orderpriority").alias("item"))


def formats_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return by.select("lang", "n", F.row_number().over(Window.orderBy(F.desc("n"), "lang")).cast("long").alias("place"))


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are assigned to the first order that has them; each chapter lists what no earlier one took."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("chapter"))


def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a, b = d.filter("doc_id % 3 <> 0").select("doc_id"), d.filter("doc_id % 5 <> 0").select("doc_id")
    return a.exceptAll(b).withColumn("side", F.lit("only first")).unionByName(b.subtract(a).withColumn("side", F.lit("only second")))


def chunk_type_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks (line items) of live parents (orders) by type, and the share with a flag, in percent."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority")
    j = table(spark, sf_dir, "lineitem").filter("l_quantity > 2").select("l_orderkey", "l_returnflag").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    by = j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("done"))
    return by.select("o_orderpriority", "n", "done", percent(F.col("done"), F.col("n")).alias("pct"))


def semi_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = table(spark, sf_dir, "embeddings").select("vec_id", "label"), table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")
    return e.join(d, F.col("vec_id") == F.col("doc_id"), "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the last 60 and 300 seconds before the last one, by type: one pass after the maximum."""
    e = table(spark, sf_dir, "events").select("event_type", "ts")
    now = e.agg(F.max("ts").alias("now"))
    age = _micros("now") - _micros("ts")
    j = e.join(F.broadcast(now))
    return j.groupBy("event_type").agg(F.sum((age < 60_000_000).cast("long")).alias("last_60"), F.sum((age < 300_000_000).cast("long")).alias("last_300"), F.sum((age < 86_400_000_000).cast("long")).alias("last_day"))


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last_update"))


def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed, success, failed and skipped tasks of each user's events, and percent done."""
    t = F.col("event_id") % 7
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.sum((t < 4).cast("long")).alias("success"), F.sum((t == 4).cast("long")).alias("failed"), F.sum((t == 5).cast("long")).alias("skipped"))
    done = F.col("success") + F.col("failed") + F.col("skipped")
    return e.select("user_id", "total", "success", "failed", "skipped", done.alias("completed"), percent(done, F.col("total")).alias("pct"))


def stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of documents merged by key: counters become rows, so that a sum adds them in place."""
    d = table(spark, sf_dir, "documents").select(F.create_map(F.lit("found"), F.col("doc_id") % 5, F.lit("missing"), F.col("doc_id") % 3, F.lit("bytes"), F.col("n_chars")).alias("m"))
    return d.select(F.explode("m").alias("counter", "v")).groupBy("counter").agg(F.sum("v").alias("total"))


def mode_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders of a customer have another number of lines than the most frequent one."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))
    j = n.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    by = j.groupBy("o_custkey", "k").agg(F.count(F.lit(1)).alias("c"))
    return by.groupBy("o_custkey").agg((F.sum("c") - F.max("c")).alias("uneven"))


def bench_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen scores against current ones: which documents fell by more than 5, and the fall of their source; every eleventh has no score now."""
    d = table(spark, sf_dir, "documents")
    frozen = d.select("doc_id", "source", (F.col("n_chars") % 100).alias("score"))
    now = d.filter("doc_id % 11 <> 0").select("doc_id", F.greatest(F.lit(0), F.col("n_chars") % 100 - F.col("doc_id") % 9).alias("score"))
    return score_gate(frozen, now, "doc_id", "source")


def judge_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins by winner over pairs that haven't been judged before: those of documents in French have."""
    judged = table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id")
    left = unjudged(table(spark, sf_dir, "labels"), judged, "doc_id")
    winner = F.when(F.col("quality") > F.col("toxic"), "quality").when(F.col("quality") < F.col("toxic"), "toxic").otherwise("tie")
    return left.groupBy(winner.alias("winner")).agg(F.count(F.lit(1)).alias("n"))


def kb_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for each base (nation), also those without documents (suppliers), in one join instead of a query each."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("c"))
    n = table(spark, sf_dir, "nation")
    return n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def route_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sniffed kind's converter first, that of the extension second; a sniffed "" or .txt never overrides, and none comes twice."""
    kinds = {".docx": "word", ".wpsx": "word", ".html": "web", ".txt": "text", ".pdf": "pdf"}
    table_of = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", pick([".docx", ".html", ".txt", "", ".wpsx"], F.col("page_id") % 5).alias("sniffed"), pick([".wpsx", ".pdf", ".html", ".zzz"], F.col("page_id") % 4).alias("ext"))
    first = F.when(~F.col("sniffed").isin("", ".txt"), F.try_element_at(table_of, F.col("sniffed")))
    both = F.array_distinct(F.array_compact(F.array(first, F.try_element_at(table_of, F.col("ext")))))
    return p.select("page_id", F.array_join(both, ">").alias("candidates"), F.when(F.size(both) == 0, "original").otherwise("convert").alias("route"))


_SEQ = "SELECT *, row_number() OVER w AS r, sum(7) OVER w AS c, coalesce(sum(length(CAST(l_partkey AS VARCHAR)) + 40) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)"

QUERIES = {
    "budget_sheet": (budget_sheet, f"SELECT l_suppkey, count(*) FILTER (r <= {ROWS} AND c <= {CELLS} AND b < {CHARS}) AS n_kept, count(*) AS n_all FROM ({_SEQ}) GROUP BY l_suppkey"),
    "budget_reason": (
        budget_reason,
        "SELECT doc_id, count(*) FILTER (why IS NULL) AS n_kept, arg_min(why, pos) FILTER (why IS NOT NULL) AS reason FROM (SELECT doc_id, pos, CASE WHEN row_number() OVER w > 8 THEN 'rows' WHEN 2 * row_number() OVER w > 30 THEN 'cells' WHEN coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 1200 THEN 'chars' END AS why FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) GROUP BY doc_id",
    ),
    "budget_greedy_attachments": (
        budget_greedy_attachments,
        f"WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations), g AS (SELECT conv_id, 0 AS k, 0::BIGINT AS used, NULL::BIGINT AS turn, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT conv_id FROM t) UNION ALL SELECT t.conv_id, t.k, CASE WHEN s <= {SINGLE} AND used + s <= {TOTAL} THEN used + s ELSE used END, t.turn, CASE WHEN s > {SINGLE} THEN 'too large' WHEN used + s <= {TOTAL} THEN 'kept' ELSE 'over budget' END FROM g JOIN t ON t.conv_id = g.conv_id AND t.k = g.k + 1) SELECT conv_id, turn, verdict FROM g WHERE k > 0",
    ),
    "column_clamp": (column_clamp, "SELECT doc_id, CAST(pos - 1 AS BIGINT) AS at, array_to_string(string_split(line, ' ')[:80], '|') AS row, len(string_split(line, ' ')) > 80 AS clamped FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)".replace(" AS at", ' AS "at"').replace(" AS row", ' AS "row"')),
    "gap_islands": (gap_islands, "SELECT user_id, island, count(*) AS n, min(sec) AS first_sec, max(sec) AS last_sec FROM (SELECT user_id, sec, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT user_id, event_id, sec, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) > 3600 THEN 1 ELSE 0 END AS fresh FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events))) GROUP BY user_id, island"),
    "last_events": (last_events, "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20"),
    "round_robin_pilot": (round_robin_pilot, "SELECT source, doc_id, turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 50"),
    "heading_jumps": (heading_jumps, "SELECT p_brand, count(*) AS jumps FROM (SELECT p_brand, p_size % 6 + 1 AS level, lag(p_size % 6 + 1) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM part) WHERE level > before + 1 GROUP BY p_brand"),
    "note_numbers": (note_numbers, "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY m, l_partkey) AS note FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS m FROM lineitem GROUP BY ALL)"),
    "list_numbers": (list_numbers, "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + o_custkey % 5 AS VARCHAR) || '. ' || o_orderpriority AS item FROM orders"),
    "formats_by_count": (formats_by_count, "SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS place FROM documents GROUP BY lang"),
    "first_wins": (first_wins, "SELECT l_partkey, min(l_orderkey) AS chapter FROM lineitem GROUP BY l_partkey"),
    "set_differences": (set_differences, "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'only first' ELSE 'only second' END AS side FROM documents WHERE (doc_id % 3 <> 0) <> (doc_id % 5 <> 0)"),
    "chunk_type_progress": (chunk_type_progress, "SELECT o_orderpriority, n, done, CASE WHEN n > 0 THEN CAST(round_even(CAST(100 * done AS DECIMAL(24, 6)) / n, 1) AS DOUBLE) ELSE 0.0 END AS pct FROM (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS done FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_quantity > 2 GROUP BY 1)"),
    "semi_embeddings": (semi_embeddings, "SELECT label, count(*) AS n FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY label"),
    "rate_windows": (rate_windows, "SELECT event_type, count(*) FILTER (age < 60000000) AS last_60, count(*) FILTER (age < 300000000) AS last_300, count(*) FILTER (age < 86400000000) AS last_day FROM (SELECT event_type, epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) AS age FROM events) GROUP BY event_type"),
    "status_histogram": (status_histogram, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderdate) AS last_update FROM orders GROUP BY ALL"),
    "job_counters": (job_counters, "SELECT *, CAST(round_even(CAST(100 * completed AS DECIMAL(24, 6)) / total, 1) AS DOUBLE) AS pct FROM (SELECT user_id, count(*) AS total, count(*) FILTER (event_id % 7 < 4) AS success, count(*) FILTER (event_id % 7 = 4) AS failed, count(*) FILTER (event_id % 7 = 5) AS skipped, count(*) FILTER (event_id % 7 < 6) AS completed FROM events GROUP BY user_id)"),
    "stats_merge": (stats_merge, "SELECT 'found' AS counter, CAST(sum(doc_id % 5) AS BIGINT) AS total FROM documents UNION ALL SELECT 'missing', CAST(sum(doc_id % 3) AS BIGINT) FROM documents UNION ALL SELECT 'bytes', CAST(sum(n_chars) AS BIGINT) FROM documents"),
    "mode_consistency": (mode_consistency, "SELECT o_custkey, CAST(sum(c) - max(c) AS BIGINT) AS uneven FROM (SELECT o_custkey, k, count(*) AS c FROM (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1"),
    "bench_gate": (bench_gate, "SELECT *, n_fell > 0 OR fall > 3 * n AS fails FROM (SELECT source, count(*) AS n, count(*) FILTER (f - c > 5) AS n_fell, CAST(sum(f - c) AS BIGINT) AS fall FROM (SELECT source, n_chars % 100 AS f, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE greatest(0, n_chars % 100 - doc_id % 9) END AS c FROM documents) GROUP BY source)"),
    "judge_wins": (judge_wins, "SELECT CASE WHEN quality > toxic THEN 'quality' WHEN quality < toxic THEN 'toxic' ELSE 'tie' END AS winner, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') GROUP BY 1"),
    "kb_fanout": (kb_fanout, "SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation"),
    "route_candidates": (
        route_candidates,
        "SELECT page_id, array_to_string(list_distinct_ordered, '>') AS candidates, CASE WHEN len(list_distinct_ordered) = 0 THEN 'original' ELSE 'convert' END AS route FROM (SELECT page_id, CASE WHEN a IS NULL AND b IS NULL THEN [] WHEN a IS NULL THEN [b] WHEN b IS NULL OR a = b THEN [a] ELSE [a, b] END AS list_distinct_ordered FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'word' WHEN 1 THEN 'web' WHEN 4 THEN 'word' END AS a, CASE page_id % 4 WHEN 0 THEN 'word' WHEN 1 THEN 'pdf' WHEN 2 THEN 'web' END AS b FROM pages))",
    ),
}
