"""Naming, links, mail, recognition and delivery queries over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.quality import let
from inkwell.operators import boxes
from inkwell.operators.aggregates import percent
from inkwell.sources.decoders import formats
from inkwell.sources.tables import table


#: Fixed value: characters of a document that a knowledge base takes.
PUSH_CHARS = 195_000


def _pick(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))


def safe_component(name: Column, limit: int = 180) -> Column:
    """A file name of at most `limit` bytes: runs of reserved and control characters as _, no dots and blanks outside, a hash where it is cut."""
    clean = F.btrim(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f\x7f]+', "_"), F.lit(". "))
    named = F.when(clean == "", "未命名").otherwise(clean)

    def cut(n: Column) -> Column:
        # the longest prefix of whole characters within the bytes that are left
        room = limit - 9
        short = F.substring(n, F.lit(1), F.lit(room))
        ends = F.filter(F.sequence(F.lit(1), F.length(short)), lambda k: F.octet_length(F.substring(short, F.lit(1), k)) <= room)
        return F.when(F.octet_length(n) <= limit, n).otherwise(F.concat(F.substring(short, F.lit(1), F.array_max(ends)), F.lit("~"), F.substring(F.sha1(n), 1, 8)))

    return let(named, cut)


def safe_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(' a/b:c*"'), F.repeat(F.lit("x"), (F.col("p_partkey") % 200).cast("int")), F.col("p_name"), F.lit("? . "))
    return table(spark, sf_dir, "part").select("p_partkey", safe_component(name).alias("name"))


def numbering_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops: list number to abstract list, and level of that to its format."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    paragraphs = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("num"))
    return paragraphs.join(n, F.col("num") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", F.coalesce("r_name", F.lit("none")).alias("fmt"))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the registry against the remote status of each: totals by what came out."""
    mine = table(spark, sf_dir, "documents").select("doc_id")
    remote = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    return mine.join(remote, F.col("doc_id") == F.col("_id"), "left").groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def recognition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    one = lambda c: F.sum(c.cast("long"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"), one(i % 3 == 0).alias("cached"), one(i % 3 != 0).alias("processed"), one(F.col("n_chars") > 500).alias("with_text"), one(F.col("n_chars") <= 500).alias("no_text"), one(i % 20 == 0).alias("failed"), F.bround(F.avg((i % 10).cast("decimal(10,4)")), 2).cast("double").alias("avg_seconds"))


def wiki_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("o_orderstatus").isin("F", "P").cast("long")).alias("completed"))
    return o.select("o_orderpriority", "total", "completed", percent(F.col("completed"), F.col("total")).alias("pct"))


def supported_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of files that are known, with their extensions and whether they can be read."""
    return formats(spark)


def body_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of 20 characters or more without html; else html if it is longer than plain; else plain."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 10)).otherwise(F.col("text")).alias("plain"), F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("!"))).otherwise("").alias("html"))
    pick = F.when((F.length("plain") >= 20) & (F.col("html") == ""), "plain").when(F.length("html") > F.length("plain"), "html").otherwise("plain")
    return t.select("conv_id", "turn", pick.alias("body"))


def attachment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are attachments: no nested mail or report, named or marked as attachment, no inline image; base64 sizes estimated."""
    i = F.col("event_id")
    kind, disp, name = _pick(["message/rfc822", "image/png", "text/plain", "application/pdf"], i), _pick(["attachment", "inline", ""], i), F.when(i % 5 == 0, "").otherwise("n")
    keep = (kind != "message/rfc822") & ((disp == "attachment") | (name != "")) & ~((kind == "image/png") & (disp == "inline"))
    size = F.when(i % 2 == 0, F.floor(i * 0.75)).otherwise(i).cast("long")
    return table(spark, sf_dir, "events").filter(keep).select("event_id", size.alias("size"))


def safe_output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that stay below the root after .. is followed; others are refused."""
    rel = F.concat(_pick(["a/", "../", "a/../", "a/../../", "/"], F.col("page_id")), F.col("page_id").cast("string"))

    def depth(parts: Column) -> Column:
        moves = F.transform(parts, lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1))
        low = F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"))
        return F.aggregate(moves, low, lambda a, m: F.struct((a["at"] + m).alias("at"), F.least(a["low"], a["at"] + m).alias("low")))["low"]

    return table(spark, sf_dir, "pages").select("page_id", ((let(F.split(rel, "/"), depth) >= 0) & ~rel.startswith("/")).alias("below"))


def root_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root table of contents of each book: fewest path parts, then the least path in lower case."""
    p = table(spark, sf_dir, "part").select("p_brand", F.concat(F.repeat(F.lit("d/"), (F.col("p_size") % 4).cast("int")), "p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    return p.groupBy("p_brand").agg(F.min_by("path", F.struct(F.size(F.split("path", "/")), F.lower("path"), F.col("path"))).alias("path"))


def archive_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives (orders) whose entries or bytes exceed the quotas are given up as a whole."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("entries"), F.sum("l_quantity").alias("bytes"))
    why = F.when(F.col("entries") > 6, "entries").when(F.col("bytes") > 150, "bytes").otherwise("ok")
    return a.groupBy(why.alias("result")).agg(F.count(F.lit(1)).alias("n"))


def page_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to render again: source hash or renderer version differ from the ones of the last run."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("h"), F.when(F.col("doc_id") % 9 == 0, "v1").otherwise("v2").alias("v"))
    old = d.filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("_id"), F.when(F.col("doc_id") % 6 == 0, "old").otherwise(F.col("h")).alias("_h"), F.col("v").alias("_v"))
    j = d.join(old, F.col("doc_id") == F.col("_id"), "left")
    return j.select("doc_id", (F.col("_h").eqNullSafe(F.col("h")) & (F.col("_v") == "v2")).alias("reused")).withColumn("reused", F.coalesce("reused", F.lit(False)))


def _grid(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(2000).select((i % 20).alias("image"), i.alias("box"), (i * 37 % 500).alias("x"), (i * 53 % 300).alias("y"), (i % 5 + 10).alias("h"), _pick(["a", "b", "c"], i * 7 % 11).alias("text"))


def greedy_box_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.drop_near(_grid(spark), "image")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.reading_order(_grid(spark).filter("y % 30 < 4"), "image").select("image", "box", "place")


def swim_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    lines = spark.range(300).select((i % 30).alias("image"), (F.floor(i / 30) * 50).alias("x"), F.lit(0).alias("y0"), (i * 31 % 100).alias("y1"), F.lit(100).alias("height"))
    return boxes.lanes(lines, "image").select("image", "x0", "x1", F.col("lane").cast("long").alias("lane"))


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    b = spark.range(400).select((i % 40).alias("cell"), i.alias("box"), (F.floor(i / 40) * 30 + F.when(i % 3 == 0, 25).otherwise(0)).alias("y"), F.lit(12).alias("h"), _pick(["p", "q"], i).alias("text"))
    return boxes.grouped_by_gap(b, "cell", 12)


def mail_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header table with at most eight attachments by name, and how many there are in all."""
    names = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))).alias("a"))
    shown = F.array_join(F.transform(F.slice("a", 1, 8), lambda s: s["l_partkey"].cast("string")), ", ")
    more = F.when(F.size("a") > 8, F.concat(F.lit(" 等 "), F.size("a").cast("string"), F.lit(" 个"))).otherwise("")
    return names.select("l_suppkey", F.concat(F.lit("| 附件 | "), shown, more, F.lit(" |")).alias("row"))


def nested_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of regions with links to their nations, in order."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    lines = F.array_join(F.transform("names", lambda x: F.concat(F.lit("  - ["), x, F.lit("]("), F.replace(x, F.lit(" "), F.lit("%20")), F.lit(".md)"))), "\n")
    j = n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("r_name", F.concat(F.lit("- "), "r_name", F.lit("\n"), lines).alias("index"))


def recognised_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text as a quote between marks, with a note where it is of low quality."""
    t = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("> "), x)), "\n")
    note = F.when(F.col("doc_id") % 4 == 0, "\n> (low)").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("> [text]\n"), t, note, F.lit("\n> [/text]")).alias("quote"))


def push_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over the cap of a knowledge base are cut; here they are repeated so that some are."""
    text = F.repeat("text", F.lit(9))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.substring(text, 1, PUSH_CHARS)).cast("long").alias("n"), (F.length(text) > PUSH_CHARS).alias("cut"))


_GRID = "SELECT i % 20 AS image, i AS box, i * 37 % 500 AS x, i * 53 % 300 AS y, i % 5 + 10 AS h, ['a', 'b', 'c'][i * 7 % 11 % 3 + 1] AS t FROM range(2000) r(i)"
_NAME = "rtrim(ltrim(regexp_replace(' a/b:c*\"' || repeat('x', CAST(p_partkey % 200 AS INT)) || p_name || '? . ', '[\\\\/:*?\"<>|\\x00-\\x1f\\x7f]+', '_', 'g'), '. '), '. ')"
_CNT = lambda c, n: f"count(*) FILTER ({c}) AS {n}"

QUERIES = {
    "safe_components": (safe_components, f"SELECT p_partkey, CASE WHEN length(n) <= 180 THEN n ELSE substr(n, 1, 171) || '~' || substr(sha1(n), 1, 8) END AS name FROM (SELECT p_partkey, {_NAME} AS n FROM part)"),
    "numbering_formats": (numbering_formats, "SELECT s_suppkey, coalesce(r_name, 'none') AS fmt FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"),
    "reconcile": (reconcile, "SELECT coalesce(CASE WHEN quality = 1 THEN 'completed' WHEN quality = 0 THEN 'failed' END, 'pending') AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "recognition_summary": (recognition_summary, "SELECT source, count(*) AS total, " + ", ".join(_CNT(c, n) for c, n in (("doc_id % 3 = 0", "cached"), ("doc_id % 3 <> 0", "processed"), ("n_chars > 500", "with_text"), ("n_chars <= 500", "no_text"), ("doc_id % 20 = 0", "failed"))) + ", CAST(round_even(CAST(CAST(sum(doc_id % 10) AS DECIMAL(18, 8)) / count(*) AS DECIMAL(18, 8)), 2) AS DOUBLE) AS avg_seconds FROM documents GROUP BY source"),
    "wiki_progress": (wiki_progress, "SELECT o_orderpriority, total, completed, CAST(round_even(CAST(100 * completed AS DECIMAL(24, 6)) / total, 1) AS DOUBLE) AS pct FROM (SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS completed FROM orders GROUP BY 1)"),
    "supported_formats": (
        supported_formats,
        "SELECT name, exts, available FROM (VALUES ('txt', 'txt', true), ('md', 'markdown,md', true), ('csv', 'csv', true), ('html', 'htm,html,xhtml', true), ('rtf', 'rtf', true), ('docx', 'docx,wpsx', true), ('xlsx', 'etx,xlsx', true), ('pptx', 'dpsx,pptx', true), ('odt', 'odt', true), ('ofd', 'ofd', true), ('eml', 'eml', true), ('xls', 'et,xls', true), "
        "('doc', 'doc,wps', true), ('msg', 'msg', true), ('pdf', 'pdf', true), ('zip', 'zip', true), ('gz', 'gz,tgz', true), ('bz2', 'bz2,tbz2', true), ('xz', 'txz,xz', true), ('tar', 'tar', true), ('chm', 'chm', false), ('ppt', 'ppt', false), ('rar', 'rar', false), ('7z', '7z', false)) v(name, exts, available)",
    ),
    "body_choice": (body_choice, "SELECT conv_id, turn, CASE WHEN length(p) >= 20 AND h = '' THEN 'plain' WHEN length(h) > length(p) THEN 'html' ELSE 'plain' END AS body FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN substr(text, 1, 10) ELSE text END AS p, CASE WHEN turn % 2 = 0 THEN text || '!' ELSE '' END AS h FROM conversations)"),
    "attachment_filter": (attachment_filter, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(floor(event_id * 0.75) AS BIGINT) ELSE event_id END AS size FROM events WHERE event_id % 4 <> 0 AND (event_id % 3 = 0 OR event_id % 5 <> 0) AND NOT (event_id % 4 = 1 AND event_id % 3 = 1)"),
    "safe_output_paths": (safe_output_paths, "SELECT page_id, page_id % 5 IN (0, 2) AS below FROM pages"),
    "root_toc": (root_toc, "SELECT p_brand, path FROM (SELECT p_brand, repeat('d/', CAST(p_size % 4 AS INT)) || p_name || '/' || CAST(p_partkey AS VARCHAR) AS path FROM part) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY len(string_split(path, '/')), lower(path), path) = 1"),
    "archive_quota": (archive_quota, "SELECT CASE WHEN e > 6 THEN 'entries' WHEN b > 150 THEN 'bytes' ELSE 'ok' END AS result, count(*) AS n FROM (SELECT l_orderkey, count(*) AS e, sum(l_quantity) AS b FROM lineitem GROUP BY 1) GROUP BY 1"),
    "page_reuse": (page_reuse, "SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 6 <> 0 AND doc_id % 9 <> 0 AS reused FROM documents"),
    "greedy_box_dedup": (
        greedy_box_dedup,
        f"WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY image, t ORDER BY box) AS k FROM ({_GRID})), g AS (SELECT image, t, 0::BIGINT AS k, []::STRUCT(box BIGINT, x BIGINT, y BIGINT)[] AS kept FROM (SELECT DISTINCT image, t FROM b) UNION ALL SELECT b.image, b.t, b.k, CASE WHEN len(list_filter(kept, lambda q: abs(q.x - b.x) <= 24 AND abs(q.y - b.y) <= 12)) > 0 THEN kept ELSE list_append(kept, {{'box': b.box, 'x': b.x, 'y': b.y}}) END FROM g JOIN b ON b.image = g.image AND b.t = g.t AND b.k = g.k + 1) SELECT image, unnest(list_transform(kept, lambda q: q.box)) AS box FROM g QUALIFY k = max(k) OVER (PARTITION BY image, t)",
    ),
    "reading_order": (
        reading_order,
        f"WITH RECURSIVE b AS (SELECT image, box, x, y, h, row_number() OVER (PARTITION BY image ORDER BY y, x, box) AS k FROM ({_GRID}) WHERE y % 30 < 4), "
        "g AS (SELECT image, 0::BIGINT AS k, []::STRUCT(y BIGINT, h BIGINT)[] AS lines, NULL::BIGINT AS box, NULL::BIGINT AS x, NULL::BIGINT AS line FROM (SELECT DISTINCT image FROM b) "
        "UNION ALL SELECT image, k, CASE WHEN m IS NULL THEN list_append(lines, {'y': y, 'h': h}) ELSE lines END, box, x, coalesce(m, len(lines) + 1) FROM (SELECT b.*, g.lines, nullif(list_position(list_transform(g.lines, lambda q: least(b.y + b.h, q.y + q.h) - greatest(b.y, q.y) > 0.5 * least(b.h, q.h)), true), 0) AS m FROM g JOIN b ON b.image = g.image AND b.k = g.k + 1)) "
        "SELECT image, box, row_number() OVER (PARTITION BY image ORDER BY line, x, box) - 1 AS place FROM g WHERE box IS NOT NULL",
    ),
    "swim_lanes": (swim_lanes, "SELECT image, x0, x1, lane FROM (SELECT image, x AS x0, lead(x) OVER w AS x1, row_number() OVER w AS lane, count(*) OVER (PARTITION BY image) AS n FROM (SELECT i % 30 AS image, i // 30 * 50 AS x, i * 31 % 100 AS y1 FROM range(300) r(i)) WHERE y1 >= 60 WINDOW w AS (PARTITION BY image ORDER BY x)) WHERE n >= 4 AND x1 IS NOT NULL"),
    "cell_texts": (cell_texts, "SELECT cell, string_agg(CASE WHEN gap > 19.2 THEN '<br>' ELSE '' END || t, '' ORDER BY y, box) AS text FROM (SELECT *, y - lag(y + 12) OVER (PARTITION BY cell ORDER BY y, box) AS gap FROM (SELECT i % 40 AS cell, i AS box, i // 40 * 30 + CASE WHEN i % 3 = 0 THEN 25 ELSE 0 END AS y, ['p', 'q'][i % 2 + 1] AS t FROM range(400) r(i))) GROUP BY cell"),
    "mail_heads": (mail_heads, "SELECT l_suppkey, '| 附件 | ' || array_to_string(a[:8], ', ') || CASE WHEN len(a) > 8 THEN ' 等 ' || CAST(len(a) AS VARCHAR) || ' 个' ELSE '' END || ' |' AS row FROM (SELECT l_suppkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_orderkey, l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1)".replace(" AS row", ' AS "row"')),
    "nested_index": (nested_index, "SELECT r_name, '- ' || r_name || chr(10) || string_agg('  - [' || n_name || '](' || replace(n_name, ' ', '%20') || '.md)', chr(10) ORDER BY n_name) AS \"index\" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "recognised_quotes": (recognised_quotes, "SELECT doc_id, '> [text]' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: '> ' || x), chr(10)) || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '> (low)' ELSE '' END || chr(10) || '> [/text]' AS quote FROM documents"),
    "push_cap": (push_cap, f"SELECT doc_id, CAST(length(substr(t, 1, {PUSH_CHARS})) AS BIGINT) AS n, length(t) > {PUSH_CHARS} AS cut FROM (SELECT doc_id, repeat(text, 9) AS t FROM documents)"),
}
