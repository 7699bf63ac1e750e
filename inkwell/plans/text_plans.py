"""Text, path, hash and naming rules over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.sources.scan import excluded
from inkwell.sources.tables import table

QUOTE_MARKS = list(T.QUOTE_MARKS)
KINDS = {".txt": "text/plain", ".md": "text/markdown", ".html": "text/html", ".pdf": "application/pdf", ".csv": "text/csv"}
#: Documents with the debris that the rules treat, made of the table's columns.
MESSY = "SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN '\ufeff' ELSE '' END, replace(text, '. ', CASE WHEN doc_id % 2 = 0 THEN concat('.', chr(13), chr(10)) ELSE concat('. ', chr(7), '|', chr(13)) END), repeat(chr(10), CAST(doc_id % 7 AS INT)), CASE WHEN doc_id % 5 = 0 THEN 'C:\\x\\' ELSE '' END, 'end', chr(127)) AS text FROM documents"
REPLIES = "SELECT conv_id, turn, concat(text, chr(10), CASE conv_id % 11 WHEN 0 THEN '---- Original Message ----' WHEN 1 THEN '> On Monday someone wrote: ' WHEN 2 THEN '--原始邮件--' WHEN 3 THEN '*--- forwarded message ---' WHEN 4 THEN '____________  ' WHEN 5 THEN concat('发件人: x', chr(10), '> Sent: y') WHEN 6 THEN '在 2024年1月2日 某人写道：' WHEN 7 THEN '-- 邮件原件 --' WHEN 8 THEN '> quoted' WHEN 9 THEN 'On x wrote: more' ELSE 'plain' END, chr(10), repeat(concat(role, ' said so. '), CAST(20 * (turn + 1) AS INT))) AS text FROM conversations"
PATHS = "SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN './' WHEN 1 THEN '../a//' WHEN 2 THEN 'b\\c\\' ELSE '/' END, replace(replace(url, '://', '/'), '?', '~'), repeat('/deep', CAST(page_id % 20 AS INT)), CASE WHEN page_id % 6 = 0 THEN concat('/', repeat('n', 200), '.html') ELSE '/x.md' END) AS path FROM pages"
WINDOWS = "SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN 'D:\\docs\\' WHEN 1 THEN 'q:\\' WHEN 2 THEN '\\\\srv\\share\\' ELSE 'rel\\' END, CAST(page_id AS VARCHAR), '.txt') AS path FROM pages"
_BS = "chr(92)"


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables, in the dialect that Spark and DuckDB share but for string types and backslashes."""
    names = [n for n in ("documents", "conversations", "pages", "orders", "lineitem", "events", "part", "nation", "region", "labels", "customer", "supplier") if f"FROM {n}" in sql]
    out = sql.replace("VARCHAR", "STRING").replace("\\", "\\\\")
    for n in names:
        out = out.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(out, **{n: table(spark, sf_dir, n) for n in names})


def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, MESSY).select("doc_id", T.sanitize(F.col("text")).alias("clean"))


def normalize_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, MESSY).select("doc_id", T.newlines(F.col("text")).alias("clean"))


def escape_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, MESSY).select("doc_id", T.escape_cell(F.col("text")).alias("cell"))


def squeeze_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return made(spark, sf_dir, MESSY).select("doc_id", T.squeeze(t, 4, 3).alias("rendered"), T.squeeze(t, 4, 2).alias("html"), T.squeeze(t, 3, 2).alias("plain"))


def fold_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, REPLIES).select("conv_id", "turn", T.fold_tail(F.col("text"), QUOTE_MARKS).alias("folded"))


def truncate_with_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 500, "[cut; characters in all] ").alias("cut"))


def normalize_rel_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, PATHS).select("page_id", T.rel_path(F.col("path")).alias("rel"))


def windows_path_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, WINDOWS).select("page_id", T.windows_path(F.col("path"), {"d": "/data/d", "srv": "/nas"}).alias("local"))


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.human_size(F.col("n_chars") * F.col("doc_id")).alias("size"))


def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, [".TXT", ".md", ".zip", ".Html", ""])), (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", T.mime_of(name, KINDS).alias("mime"))


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.link_target(F.concat("url", F.lit("#top"))).alias("target"))


def exclude_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths none of whose parts below the root match an exclude."""
    paths = made(spark, sf_dir, "SELECT page_id, concat(CASE page_id % 6 WHEN 0 THEN '.git/a' WHEN 1 THEN 'docs/_x/b' WHEN 2 THEN 'c/~lock' WHEN 3 THEN 'd.tmp' ELSE 'e/f' END, CASE WHEN page_id % 10 = 4 THEN '.bak' ELSE '.md' END) AS rel FROM pages")
    return paths.filter(~excluded(F.col("rel"))).select("page_id", "rel")


def unique_sibling_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made unique by case-insensitive number within a directory (here: a brand), in key order."""
    order = Window.partitionBy("p_brand", F.lower("p_name")).orderBy("p_partkey")
    k = F.row_number().over(order)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit("_"), k.cast("string"))).alias("name"))


def output_rel_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txt and csv keep their extension before .md; other sources change theirs; .md stays."""
    name = F.concat(F.lit("d/n"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, [".txt", ".csv", ".md", ".docx", ".tar.gz"])), (F.col("page_id") % 5 + 1).cast("int")))
    out = F.when(name.rlike(r"\.md$"), name).when(name.rlike(r"\.(txt|csv)$"), F.concat(name, F.lit(".md"))).otherwise(F.concat(F.regexp_replace(name, r"\.[^./]+$", ""), F.lit(".md")))
    return table(spark, sf_dir, "pages").select("page_id", out.alias("rel"))


def content_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"), F.sha1(F.col("text")).alias("sha1"))


def composite_source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha1 over the sha1 of each file of a source, in order; "missing" for an unreadable one."""
    each = F.struct("doc_id", F.when(F.col("doc_id") % 13 == 0, F.lit("missing")).otherwise(F.sha1("text")).alias("h"))
    listed = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_list(each)).alias("x"))
    return listed.select("source", F.sha1(F.array_join(F.transform("x", lambda s: s["h"]), "")).alias("hash"))


def render_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set(F.concat("lang", F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".md")))).alias("p"))
    return outputs.select("source", F.sha1(F.concat(F.lit("v3|tree|"), F.array_join("p", "\n"))).alias("fingerprint"))


def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def text_substance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.functions.quality import MARKUP

    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.translate("text", MARKUP, "")).cast("long").alias("substance"))


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML front matter with quoted scalars."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("---\ntitle: "), q(F.col("p_name")), F.lit("\ntype: "), q(F.col("p_type")), F.lit("\n---\n")).alias("head"))


def cjk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined without a blank between two CJK characters, else with one."""
    made_lines = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("第一行"), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise(""), F.lit("\n"), F.when(F.col("p_partkey") % 3 == 0, "第二").otherwise("two"), F.lit("\nend")).alias("t"))
    cjk = "[\u3400-\u9fff\uf900-\ufaff\u3000-\u303f\uff00-\uffef]"
    return made_lines.select("p_partkey", F.regexp_replace(F.regexp_replace("t", f"(?<={cjk})\n(?={cjk})", ""), "\n", " ").alias("line"))


def checkbox_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("o_orderstatus") == "F", "- [x] ").otherwise("- [ ] ")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(mark, F.col("o_orderpriority")).alias("item"))


def cell_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date without a time where the time is midnight."""
    ts = F.col("ts")
    midnight = F.date_trunc("day", ts) == ts
    return table(spark, sf_dir, "events").select("event_id", F.when(midnight, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("cell"))


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min(2^(retry + 1), 10), raised to a server's retry-after of at most 60."""
    retry, after = (F.col("event_id") % 6).cast("int"), (F.col("event_id") % 100).cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.least(F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), retry + 1), F.lit(10.0)), F.least(after, F.lit(60)).cast("double")).alias("delay"))


def sniff_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.sources.sniff import sniff_head

    heads = ["ITSF", "%PDF-1", "{\\rtf1", "<html><body>", "<!doctype html>", "From x@y", "Delivered-To: a", "a,b,c\n1,2,3\n", "plain words", "a,b\n1,2,3\n", "MIME-Version: 1.0"]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("page_id") % len(heads) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", sniff_head(F.encode(head, "UTF-8")).alias("kind"))


def sniff_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.sources.sniff import looks_like_csv

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", looks_like_csv(F.substring("text", 1, 256)).alias("csv"))


_N = "regexp_replace({0}, '\\r\\n?', chr(10), 'g')"
_FOLD_AT = "list_min(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?m){m}') THEN length(regexp_extract(text, '(?ms)\\A(.*?){m}', 1)) + 1 END" for m in QUOTE_MARKS) + "], lambda x: x IS NOT NULL))"

QUERIES = {
    "sanitize_text": (sanitize_text, f"SELECT doc_id, {_N.format(chr(34) + 'c' + chr(34))} AS clean FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\ufeff', ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS c FROM ({MESSY}))"),
    "normalize_newlines": (normalize_newlines, f"SELECT doc_id, {_N.format('text')} AS clean FROM ({MESSY})"),
    "escape_cell": (escape_cell, f"SELECT doc_id, trim(replace(replace(replace(replace(text, {_BS}, {_BS} || {_BS}), '|', {_BS} || '|'), chr(13) || chr(10), '<br>'), chr(10), '<br>'), E' \\t\\n\\r\\x0b\\x0c') AS cell FROM ({MESSY})"),
    "squeeze_newlines": (squeeze_newlines, f"SELECT doc_id, regexp_replace(text, '\\n{{4,}}', repeat(chr(10), 3), 'g') AS rendered, regexp_replace(text, '\\n{{4,}}', repeat(chr(10), 2), 'g') AS html, regexp_replace(text, '\\n{{3,}}', repeat(chr(10), 2), 'g') AS plain FROM ({MESSY})"),
    "fold_quoted": (fold_quoted, f"SELECT conv_id, turn, CASE WHEN m IS NULL OR length(text) - m + 1 <= 600 THEN text ELSE concat(substr(text, 1, m - 1), '[folded ', CAST(length(text) - m + 1 AS VARCHAR), '] ', substr(text, m, 400)) END AS folded FROM (SELECT *, {_FOLD_AT} AS m FROM ({REPLIES}))"),
    "truncate_with_note": (truncate_with_note, "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE concat(substr(text, 1, 500), chr(10), chr(10), '[cut; characters in all] ', CAST(length(text) AS VARCHAR)) END AS cut FROM documents"),
    "normalize_rel_path": (
        normalize_rel_path,
        f"SELECT page_id, substr(array_to_string(list_transform(p[greatest(1, len(p) - 15):], lambda s: CASE WHEN length(s) <= 128 THEN s ELSE substr(s, 1, 128 - length(regexp_extract(s, '(\\.[^.]{{1,10}})$', 1))) || regexp_extract(s, '(\\.[^.]{{1,10}})$', 1) END), '/'), 1, 1024) AS rel FROM (SELECT page_id, list_filter(string_split(replace(path, {_BS}, '/'), '/'), lambda s: s NOT IN ('', '.', '..')) AS p FROM ({PATHS}))",
    ),
    "windows_path_map": (windows_path_map, f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/data/d/docs/' WHEN 1 THEN '/mnt/q/' WHEN 2 THEN '/nas/share/' ELSE 'rel/' END || CAST(page_id AS VARCHAR) || '.txt' AS local FROM pages"),
    "human_sizes": (human_sizes, "SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024) || ' KB' ELSE printf('%.1f', n / 1048576) || ' MB' END AS size FROM (SELECT doc_id, n_chars * doc_id AS n FROM documents)"),
    "mime_types": (mime_types, "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 3 THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM pages"),
    "link_targets": (link_targets, "SELECT page_id, url_decode(replace(regexp_extract(url, '^[^#?]*'), '+', '%2B')) AS target FROM pages"),
    "exclude_globs": (exclude_globs, "SELECT page_id, concat(CASE WHEN page_id % 6 = 3 THEN 'd.tmp' ELSE 'e/f' END, '.md') AS rel FROM pages WHERE page_id % 6 IN (3, 4, 5) AND page_id % 10 <> 4"),
    "unique_sibling_names": (unique_sibling_names, "SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '_' || CAST(k AS VARCHAR) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS k FROM part)"),
    "output_rel_naming": (output_rel_naming, "SELECT page_id, 'd/n' || CAST(page_id AS VARCHAR) || CASE page_id % 5 WHEN 0 THEN '.txt.md' WHEN 1 THEN '.csv.md' WHEN 4 THEN '.tar.md' ELSE '.md' END AS rel FROM pages"),
    "content_sha256": (content_sha256, "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents"),
    "composite_source_hash": (composite_source_hash, "SELECT source, sha1(string_agg(CASE WHEN doc_id % 13 = 0 THEN 'missing' ELSE sha1(text) END, '' ORDER BY doc_id)) AS hash FROM documents GROUP BY source"),
    "render_fingerprint": (render_fingerprint, "SELECT source, sha1('v3|tree|' || array_to_string(list_sort(list(DISTINCT lang || '/' || CAST(doc_id % 50 AS VARCHAR) || '.md')), chr(10))) AS fingerprint FROM documents GROUP BY source"),
    "exact_duplicate_groups": (exact_duplicate_groups, "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1"),
    "text_substance": (text_substance, "SELECT doc_id, CAST(length(translate(text, E'#*|-[]>`~\\n\\r\\t ', '')) AS BIGINT) AS substance FROM documents"),
    "front_matter": (front_matter, f"SELECT p_partkey, concat('---', chr(10), 'title: \"', replace(replace(p_name, {_BS}, {_BS} || {_BS}), '\"', {_BS} || '\"'), '\"', chr(10), 'type: \"', replace(replace(p_type, {_BS}, {_BS} || {_BS}), '\"', {_BS} || '\"'), '\"', chr(10), '---', chr(10)) AS head FROM part"),
    "cjk_join": (cjk_join, "SELECT p_partkey, concat('第一行', CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END, CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN '' ELSE ' ' END, CASE WHEN p_partkey % 3 = 0 THEN '第二' ELSE 'two' END, ' end') AS line FROM part"),
    "checkbox_text": (checkbox_text, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '- [x] ' ELSE '- [ ] ' END || o_orderpriority AS item FROM orders"),
    "cell_dates": (cell_dates, "SELECT event_id, CASE WHEN date_trunc('day', ts) = ts THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS cell FROM events"),
    "retry_delays": (retry_delays, "SELECT event_id, greatest(least(pow(2.0, event_id % 6 + 1), 10.0), CAST(least(event_id % 100, 60) AS DOUBLE)) AS delay FROM events"),
    "sniff_magic": (sniff_magic, "SELECT page_id, CASE page_id % 11 WHEN 0 THEN 'chm' WHEN 1 THEN 'pdf' WHEN 2 THEN 'rtf' WHEN 3 THEN 'html' WHEN 4 THEN 'html' WHEN 5 THEN 'eml' WHEN 6 THEN 'eml' WHEN 7 THEN 'csv' WHEN 10 THEN 'eml' ELSE 'txt' END AS kind FROM pages"),
    "sniff_csv": (sniff_csv, "SELECT conv_id, turn, len(string_split(h, chr(10))) >= 2 AND len(c) >= 2 AND list_min(c) > 0 AND list_min(c) = list_max(c) AS csv FROM (SELECT *, list_transform(list_filter(string_split(h, chr(10))[:3], lambda x: trim(x) <> ''), lambda x: length(x) - length(replace(x, ',', ''))) AS c FROM (SELECT conv_id, turn, substr(text, 1, 256) AS h FROM conversations))"),
}
