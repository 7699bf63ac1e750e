"""Incremental queries. The earlier run is derived from the documents: each 7th changed, each 11th is new, each 13th is gone now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import sync
from inkwell.sources.tables import table

VERSION = "v2"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.sha1("text").alias("hash"))


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter("doc_id % 13 <> 0")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).filter("doc_id % 11 <> 0")
    hashed = F.when(F.col("doc_id") % 7 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash"))
    return d.select("doc_id", "source", hashed.alias("hash"), F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("converted").alias("status"), F.when(F.col("doc_id") % 17 == 0, "v1").otherwise(VERSION).alias("version"), (F.col("doc_id") % 2 == 0).alias("pushed"), F.array(F.concat(F.lit("out/"), F.col("doc_id").cast("string"))).alias("outputs"))


def needs_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.needs_convert(_current(spark, sf_dir), _registry(spark, sf_dir), "doc_id", VERSION).filter("reason IS NOT NULL").select("doc_id", "reason")


def skip_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = _registry(spark, sf_dir)
    outputs = reg.select("doc_id", F.explode("outputs").alias("path"))
    disk = outputs.filter("doc_id % 3 <> 0").select("path")
    return sync.skip_complete(_current(spark, sf_dir), reg, outputs, disk, "doc_id", VERSION)


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.page_diff(_current(spark, sf_dir).select("source", "doc_id", "hash"), _registry(spark, sf_dir).select("source", "doc_id", "hash"), ["source", "doc_id"])


def page_hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).filter("change <> 'same'")


def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.changed_pages(_diff(spark, sf_dir), "source", _registry(spark, sf_dir).filter("source <> 'src3'"))


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).groupBy("source").agg(*(F.sum((F.col("change") == c).cast("long")).alias(c) for c in ("added", "modified", "gone", "same")))


def vanished_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.vanished(_registry(spark, sf_dir), _current(spark, sf_dir), "doc_id").select("doc_id", "source", "pushed")


def prune_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _current(spark, sf_dir).select(F.col("doc_id").alias("_id"))
    return _registry(spark, sf_dir).join(seen, F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", "hash", "status")


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = _registry(spark, sf_dir)
    new = _current(spark, sf_dir).filter("doc_id % 7 = 0 OR doc_id % 11 = 0").select("doc_id", "source", "hash", F.lit("converted").alias("status"), F.lit(VERSION).alias("version"))
    return sync.upsert(reg, new, "doc_id").select("doc_id", "hash", "status", "version", "pushed", F.array_join("outputs", ",").alias("outputs"))


def mark_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after a push of the documents divisible by 3."""
    done = _docs(spark, sf_dir).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("_id"))
    joined = _registry(spark, sf_dir).join(done, F.col("doc_id") == F.col("_id"), "left")
    return joined.select("doc_id", (F.col("pushed") | F.col("_id").isNotNull()).alias("pushed"))


def push_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run pushes: converted, not pushed yet, and still there."""
    seen = _current(spark, sf_dir).select(F.col("doc_id").alias("_id"))
    return _registry(spark, sf_dir).filter("status = 'converted' AND NOT pushed").join(seen, F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", "hash")


def longest_prefix_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^\w+://[^/]*/?", "").alias("path"))
    return sync.longest_prefix(pages, "path", MAPPING, "kb0").select("page_id", "target")


MAPPING = {"en": "kb1", "en/1": "kb2", "fr": "kb3", "de": "", "es": "kb4"}


def kb_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))
    refs = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_regionkey").cast("string")).when(F.col("n_nationkey") % 3 == 1, F.lit("ASIA")).otherwise(F.col("n_name")).alias("ref")).distinct()
    return sync.resolve_ids(refs, known)


def ocr_cache_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without a cached result of the current settings; entries without a signature count."""
    images = _docs(spark, sf_dir).select("hash").distinct()
    cache = _docs(spark, sf_dir).filter("doc_id % 2 = 0").select(F.col("hash").alias("_hash"), F.when(F.col("doc_id") % 3 == 0, F.lit("old")).when(F.col("doc_id") % 3 == 1, F.lit("now")).alias("sig"))
    good = cache.filter("sig IS NULL OR sig = 'now'").select("_hash")
    return images.join(good, F.col("hash") == F.col("_hash"), "left_anti")


def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = sync.vanished(_registry(spark, sf_dir), _current(spark, sf_dir), "doc_id")
    return gone.groupBy("source").agg(F.count(F.lit(1)).alias("missing"), F.sum(F.col("pushed").cast("long")).alias("deleted"), F.sum((F.col("status") == "failed").cast("long")).alias("failed"), F.countDistinct("hash").alias("doc_ids"))


def deprecated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is deprecated by the name of a directory above it, never by its own."""
    path = F.concat(F.lit("root/"), F.element_at(F.array(*map(F.lit, ["作废", "新", "已废止项", "废止", "x"])), (F.col("page_id") % 5 + 1).cast("int")), F.lit("/"), F.when(F.col("page_id") % 2 == 0, "废止.html").otherwise("a.html"))
    above = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return table(spark, sf_dir, "pages").select("page_id", F.exists(above, lambda d: d.rlike("已废止|废止|作废")).alias("deprecated"))


def scaffold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stay unless all their files have scaffold names (here: documents divisible by 4 or of one language)."""
    scaffold = (F.col("doc_id") % 4 == 0) | (F.col("lang") == "en")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(scaffold.cast("int")).alias("all_scaffold")).filter("all_scaffold = 0").select("source", "n")


def scan_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, [".docx", ".pdf", ".html", ".md"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bytes"))


_REG = "reg AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN hash || 'x' ELSE hash END AS hash, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'converted' END AS status, CASE WHEN doc_id % 17 = 0 THEN 'v1' ELSE 'v2' END AS version, doc_id % 2 = 0 AS pushed FROM d WHERE doc_id % 11 <> 0)"
_WITH = f"WITH d AS (SELECT doc_id, source, lang, sha1(text) AS hash FROM documents), cur AS (SELECT * FROM d WHERE doc_id % 13 <> 0), {_REG}"
_NEED = "need AS (SELECT cur.doc_id, CASE WHEN reg.doc_id IS NULL THEN 'new' WHEN reg.hash <> cur.hash THEN 'changed' WHEN version <> 'v2' THEN 'version' WHEN status <> 'converted' THEN 'failed' END AS reason FROM cur LEFT JOIN reg USING (doc_id))"
_DIFF = "diff AS (SELECT coalesce(cur.source, reg.source) AS source, coalesce(cur.doc_id, reg.doc_id) AS doc_id, CASE WHEN reg.hash IS NULL THEN 'added' WHEN cur.hash IS NULL THEN 'gone' WHEN cur.hash <> reg.hash THEN 'modified' ELSE 'same' END AS change FROM cur FULL JOIN reg ON cur.doc_id = reg.doc_id)"
_SUM = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"

QUERIES = {
    "needs_convert": (needs_convert, f"{_WITH}, {_NEED} SELECT doc_id, reason FROM need WHERE reason IS NOT NULL"),
    "skip_complete": (skip_complete, f"{_WITH}, {_NEED} SELECT doc_id FROM need WHERE reason IS NULL AND doc_id % 3 <> 0"),
    "page_hash_diff": (page_hash_diff, f"{_WITH}, {_DIFF} SELECT source, doc_id, change FROM diff WHERE change <> 'same'"),
    "changed_pages": (changed_pages, f"{_WITH}, {_DIFF} SELECT source, CASE WHEN source = 'src3' THEN 'all' WHEN {_SUM('change IN (' + chr(39) + 'added' + chr(39) + ', ' + chr(39) + 'modified' + chr(39) + ')')} > 0 THEN 'some' ELSE 'none' END AS push, CAST(count(*) FILTER (change IN ('added', 'modified')) AS BIGINT) AS n_push, CAST(count(*) FILTER (change = 'gone') AS BIGINT) AS n_gone FROM diff GROUP BY source"),
    "manifest_diff": (manifest_diff, f"{_WITH}, {_DIFF} SELECT change, count(*) AS n FROM diff GROUP BY change"),
    "sync_report": (sync_report, f"{_WITH}, {_DIFF} SELECT source, " + ", ".join(f"count(*) FILTER (change = '{c}') AS {c}" for c in ("added", "modified", "gone", "same")) + " FROM diff GROUP BY source"),
    "vanished_sources": (vanished_sources, f"{_WITH} SELECT doc_id, source, pushed FROM reg WHERE doc_id NOT IN (SELECT doc_id FROM cur)"),
    "prune_registry": (prune_registry, f"{_WITH} SELECT doc_id, hash, status FROM reg WHERE doc_id IN (SELECT doc_id FROM cur)"),
    "registry_upsert": (
        registry_upsert,
        f"{_WITH}, new AS (SELECT * FROM cur WHERE doc_id % 7 = 0 OR doc_id % 11 = 0) SELECT coalesce(new.doc_id, reg.doc_id) AS doc_id, coalesce(new.hash, reg.hash) AS hash, CASE WHEN new.doc_id IS NOT NULL THEN 'converted' ELSE status END AS status, CASE WHEN new.doc_id IS NOT NULL THEN 'v2' ELSE version END AS version, CASE WHEN new.doc_id IS NOT NULL THEN false ELSE pushed END AS pushed, CASE WHEN reg.doc_id IS NULL THEN '' ELSE 'out/' || CAST(reg.doc_id AS VARCHAR) END AS outputs FROM new FULL JOIN reg ON new.doc_id = reg.doc_id",
    ),
    "mark_pushed": (mark_pushed, f"{_WITH} SELECT doc_id, pushed OR doc_id % 3 = 0 AS pushed FROM reg"),
    "push_todo": (push_todo, f"{_WITH} SELECT doc_id, hash FROM reg WHERE status = 'converted' AND NOT pushed AND doc_id % 13 <> 0"),
    "longest_prefix_route": (longest_prefix_route, "SELECT page_id, CASE WHEN p = 'en/1' OR starts_with(p, 'en/1/') THEN 'kb2' WHEN p = 'en' OR starts_with(p, 'en/') THEN 'kb1' WHEN p = 'fr' OR starts_with(p, 'fr/') THEN 'kb3' WHEN p = 'es' OR starts_with(p, 'es/') THEN 'kb4' ELSE 'kb0' END AS target FROM (SELECT page_id, regexp_replace(url, '^\\w+://[^/]*/?', '') AS p FROM pages)"),
    "kb_resolve_id_or_name": (kb_resolve, "SELECT ref, coalesce((SELECT CAST(r_regionkey AS VARCHAR) FROM region WHERE CAST(r_regionkey AS VARCHAR) = ref), (SELECT CAST(r_regionkey AS VARCHAR) FROM region WHERE r_name = ref)) AS id FROM (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN CAST(n_regionkey AS VARCHAR) WHEN 1 THEN 'ASIA' ELSE n_name END AS ref FROM nation)"),
    "ocr_cache_todo": (ocr_cache_todo, f"{_WITH} SELECT DISTINCT hash FROM d WHERE hash NOT IN (SELECT hash FROM d WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0)"),
    "missing_report": (missing_report, f"{_WITH} SELECT source, count(*) AS missing, {_SUM('pushed')} AS deleted, {_SUM('status = ' + chr(39) + 'failed' + chr(39))} AS failed, count(DISTINCT hash) AS doc_ids FROM reg WHERE doc_id % 13 = 0 GROUP BY source"),
    "deprecated_docs": (deprecated_docs, "SELECT page_id, page_id % 5 IN (0, 2, 3) AS deprecated FROM pages"),
    "scaffold_filter": (scaffold_filter, "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING bool_and(doc_id % 4 = 0 OR lang = 'en') = false"),
    "scan_stats_by_ext": (scan_by_ext, "SELECT ['.docx', '.pdf', '.html', '.md'][doc_id % 4 + 1] AS ext, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1"),
}
