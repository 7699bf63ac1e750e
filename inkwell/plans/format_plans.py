"""Decoding, rendering and geometry queries. Files of the binary formats are packed from table rows, decoded, and compared with these."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.render import document_markdown, table_markdown
from inkwell.operators import geometry
from inkwell.sources.decoders import decode_files
from inkwell.sources.tables import spread, table


def _zip_of(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _esc(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def pack(kind: str, words: list[str]) -> bytes:
    """A file of the kind that holds the words as paragraphs (rows of a table in sheets)."""
    if kind == "docx":
        body = "".join(f"<w:p><w:r><w:t>{_esc(w)}</w:t></w:r></w:p>" for w in words)
        return _zip_of({"[Content_Types].xml": "<x/>", "word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'})
    if kind == "pptx":
        body = "".join(f"<a:p><a:r><a:t>{_esc(w)}</a:t></a:r></a:p>" for w in words)
        return _zip_of({"ppt/presentation.xml": "<x/>", "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a">{body}</p:sld>'})
    if kind == "xlsx":
        cells = "</row><row>".join(f'<c r="A{i}" t="inlineStr"><is><t>{_esc(w)}</t></is></c>' for i, w in enumerate(words, 1))
        return _zip_of({"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>', "xl/worksheets/s.xml": f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>"})
    if kind == "odt":
        return _zip_of({"META-INF/manifest.xml": "<x/>", "content.xml": "<c>" + "".join(f"<p>{_esc(w)}</p>" for w in words) + "</c>"})
    if kind == "ofd":
        body = "".join(f'<TextObject Boundary="10 {20 * i + 10} 90 8" Size="4"><TextCode>{_esc(w)}</TextCode></TextObject>' for i, w in enumerate(words))
        return _zip_of({"OFD.xml": "<x/>", "Doc_0/Pages/Page_0/Content.xml": f"<Page>{body}</Page>"})
    if kind == "rtf":
        units = lambda c: struct.unpack(f"<{len(c.encode('utf-16-le')) // 2}h", c.encode("utf-16-le"))
        codes = lambda w: "".join("".join(f"\\u{u}?" for u in units(c)) if ord(c) > 126 or c in "\\{}" else c for c in w)
        return ("{\\rtf1\\ansi{\\fonttbl{\\f0 X;}}" + "\\par ".join(codes(w) for w in words) + "}").encode("ascii")
    if kind == "eml":
        return ("From: a@example.com\nSubject: s\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n" + "\n".join(words)).encode()
    if kind == "zip":
        return _zip_of({"d/a.txt": "\n".join(words), "../away.txt": "x", "b.docx": "not a document"})
    return "\n".join(words).encode()


KINDS = ("docx", "pptx", "xlsx", "odt", "ofd", "rtf", "eml", "zip", "txt", "pdf")


def _packed(all_kinds: tuple[str, ...]):
    """Each document as a file of one of the kinds, in turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                ids, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                kinds = [all_kinds[i % len(all_kinds)] for i in ids]
                data = [b"%PDF-1.4 x" if k == "pdf" else pack(k, w) for k, w in zip(kinds, words, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{i}.{k}" for i, k in zip(ids, kinds, strict=True)]), pa.array(data, pa.binary())], ["path", "content"])

    return run, "path string, content binary"


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of each document that aren't blank, trimmed, with single blanks."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(F.regexp_replace(x, " +", " "))), lambda x: x != "")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", lines.alias("lines"))


def decode_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents packed in ten formats and decoded: the same text again, or the error of the format."""
    out = decode_files(_document_lines(spark, sf_dir).mapInArrow(*_packed(KINDS)))
    plain = F.filter("blocks", lambda b: ~((b["kind"] == "h") | (b["kind"] == "table") & F.endswith(F.col("path"), F.lit(".eml"))))
    text = F.array_join(F.transform(plain, lambda b: F.when(b["kind"] == "table", F.array_join(F.flatten(b["rows"]), "\n")).otherwise(b["text"])), "\n")
    return out.select("path", "kind", F.coalesce("error", F.lit("")).alias("error"), F.sha2(text, 256).alias("text_sha"))


def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs and failures of each document's archive: the rows of its manifest."""
    out = decode_files(_document_lines(spark, sf_dir).mapInArrow(*_packed(("zip",))))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").isNotNull().cast("long")).alias("failed"), F.sum(F.length(F.array_join(F.transform("blocks", lambda b: b["text"]), "")).cast("long")).alias("chars"))


def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return decode_files(pages).select(F.split("path", r"\.")[0].cast("long").alias("page_id"), document_markdown(F.col("blocks")).alias("markdown"))


def html_title_links_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_count(h, F.lit(r"(?i)<a\s[^>]*href=")).cast("long").alias("n_links"), F.regexp_count(h, F.lit(r"(?i)<img\s")).cast("long").alias("n_images"), F.length(F.regexp_replace(h, r"(?is)<(script|style)\b.*?</(script|style)>", "")).cast("long").alias("n_left"))


def csv_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as a CSV file, decoded and rendered."""
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name")
    files = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("key,name,\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("t"))
    files = files.select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("path"), F.encode("t", "UTF-8").alias("content"))
    return decode_files(files).select("path", document_markdown(F.col("blocks")).alias("markdown"))


def render_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose last cells are empty on some rows; one row is empty."""
    row = F.array(F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("a|"), F.col("n_nationkey").cast("string"))))
    rows = F.concat(F.array(row), F.array(F.array(F.lit(""), F.lit("")), F.array(F.lit("x\ny"), F.lit("z"))))
    return table(spark, sf_dir, "nation").select("n_nationkey", table_markdown(rows).alias("markdown"))


def render_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "struct<kind:string,level:int,text:string,rows:array<array<string>>>"

    def block(k: str, level, text):
        return F.struct(F.lit(k).alias("kind"), F.lit(level).cast("int").alias("level") if isinstance(level, int) else level.cast("int").alias("level"), text.alias("text"), F.lit(None).cast("array<array<string>>").alias("rows")).cast(kind)

    size = F.col("p_size") % 6 + 1
    blocks = F.array(block("h", size, F.col("p_name")), block("p", 0, F.col("p_type")), block("li", 0, F.col("p_brand")), block("li", 1, F.lit("1. inner")), block("quote", 0, F.concat(F.col("p_brand"), F.lit("\nend"))), block("p", 0, F.lit("")), block("p", 0, F.lit("")), block("p", 0, F.lit("tail")))
    return table(spark, sf_dir, "part").select("p_partkey", document_markdown(blocks, F.col("p_name")).alias("markdown"))


def image_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", (200 + F.col("n_chars") % 3000).cast("int").alias("width"), (100 + (F.col("n_chars") * 7) % 2500).cast("int").alias("height"))
    return geometry.tiles(sized).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))


def prefix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin a longer line of the same document."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.trim(x))
    return table(spark, sf_dir, "documents").select("doc_id", geometry.prefix_pairs(lines).cast("long").alias("pairs"))


def ocr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 4 == 0, "").otherwise("t").alias("t"), F.when(i % 3 > 0, (i % 10) / 10).alias("s"))
    level = geometry.confidence(F.col("t"), F.col("s"), i % 5 == 0, i % 7, i % 400, i % 31 == 0, i % 37 == 0)
    return d.select("doc_id", level.alias("level"))


def range_join_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of ten images in a grid of four lanes and three bands."""
    boxes = spark.range(5000).select((F.col("id") % 10).alias("image"), F.col("id").alias("box"), (F.col("id") * 37 % 400).alias("cx"), (F.col("id") * 53 % 330).alias("cy"))
    lanes = spark.range(40).select((F.col("id") % 10).alias("image"), F.floor(F.col("id") / 10).alias("lane")).select("image", "lane", (F.col("lane") * 90).alias("x0"), (F.col("lane") * 90 + 90).alias("x1"))
    bands = spark.range(30).select((F.col("id") % 10).alias("image"), F.floor(F.col("id") / 10).alias("band")).select("image", "band", (F.col("band") * 100).alias("y0"), (F.col("band") * 100 + 100).alias("y1"))
    return geometry.in_cells(boxes, lanes, bands, "image").groupBy("image", "lane", "band").agg(F.count(F.lit(1)).alias("n"))


def drop_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.range(600).select((F.col("id") % 6).alias("image"), F.col("id").alias("box"), (F.col("id") % 50 * 20).alias("x"), (F.floor(F.col("id") / 50) * 30).alias("y"), F.lit(25).alias("w"), F.lit(20).alias("h"), F.substring(F.lit("abcdefgh"), F.lit(1), (F.col("id") % 7 + 2).cast("int")).alias("text"))
    return geometry.drop_contained(boxes, "image").select("image", "box")


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '')"
_BOX = "SELECT i % 6 AS image, i AS box, i % 50 * 20 AS x, i // 50 * 30 AS y, 25 AS w, 20 AS h, substr('abcdefgh', 1, i % 7 + 2) AS t FROM range(600) r(i)"

QUERIES = {
    "decode_packed": (
        decode_packed,
        f"WITH d AS (SELECT doc_id, ['docx', 'pptx', 'xlsx', 'odt', 'ofd', 'rtf', 'eml', 'zip', 'txt', 'pdf'][doc_id % 10 + 1] AS k, array_to_string({_LINES}, chr(10)) AS t FROM documents) "
        "SELECT CAST(doc_id AS VARCHAR) || '.' || k || CASE WHEN k = 'zip' THEN '/d/a.txt' ELSE '' END AS path, CASE WHEN k = 'zip' THEN 'txt' ELSE k END AS kind, CASE WHEN k = 'pdf' THEN 'needs_ocr' ELSE '' END AS error, sha256(CASE WHEN k = 'pdf' THEN '' ELSE t END) AS text_sha FROM d "
        "UNION ALL SELECT CAST(doc_id AS VARCHAR) || '.zip/b.docx', 'docx', 'malformed_document', sha256('') FROM d WHERE k = 'zip'",
    ),
    "archive_summary": (archive_summary, f"SELECT CAST(doc_id AS VARCHAR) || '.zip' AS source, CAST(2 AS BIGINT) AS n, CAST(1 AS BIGINT) AS failed, CAST(length(array_to_string({_LINES}, chr(10))) AS BIGINT) AS chars FROM documents"),
    "html_to_markdown": (html_to_markdown, None),
    "html_title_links_images": (html_title_links_images, "SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '(?i)<img\\s')) AS BIGINT) AS n_images, CAST(length(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g')) AS BIGINT) AS n_left FROM pages"),
    "csv_to_markdown": (csv_to_markdown, "SELECT CAST(n_regionkey AS VARCHAR) || '.csv' AS path, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' |', chr(10) ORDER BY CAST(n_nationkey AS VARCHAR) || ',' || n_name) AS markdown FROM nation GROUP BY n_regionkey"),
    "render_tables": (render_tables, "SELECT n_nationkey, chr(10) || '| ' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' |' || chr(10) || '| --- |' ELSE ' | a' || chr(92) || '|' || CAST(n_nationkey AS VARCHAR) || ' |' || chr(10) || '| --- | --- |' END || chr(10) || '| x<br>y | z |' || chr(10) AS markdown FROM nation"),
    "render_blocks": (render_blocks, "SELECT p_partkey, concat('# ', p_name, chr(10), chr(10), chr(10), repeat('#', p_size % 6 + 1), ' ', p_name, chr(10), chr(10), p_type, chr(10), '- ', p_brand, chr(10), '  1. inner', chr(10), chr(10), '> ', p_brand, chr(10), '> end', chr(10), chr(10), chr(10), 'tail') AS markdown FROM part".replace("'> end', chr(10), chr(10), chr(10), 'tail'", "'> end', chr(10), chr(10), chr(10), 'tail'")),
    "image_tiles": (
        image_tiles,
        "WITH s AS (SELECT doc_id, 200 + n_chars % 3000 AS w, 100 + (n_chars * 7) % 2500 AS h FROM documents), xs AS (SELECT DISTINCT doc_id, w, h, unnest(CASE WHEN w <= 960 THEN [0::BIGINT] ELSE list_append(range(0, w - 960 + 1, 864), w - 960) END) AS x0 FROM s), xy AS (SELECT DISTINCT *, unnest(CASE WHEN h <= 960 THEN [0::BIGINT] ELSE list_append(range(0, h - 960 + 1, 864), h - 960) END) AS y0 FROM xs) SELECT doc_id, x0, y0, least(w, x0 + 960) AS x1, least(h, y0 + 960) AS y1 FROM xy",
    ),
    "prefix_pairs": (prefix_pairs, "SELECT doc_id, CAST(len(list_filter(ls, lambda a: len(list_filter(ls, lambda b: length(a) < length(b) AND starts_with(b, a))) > 0)) AS BIGINT) AS pairs FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 2) AS ls FROM documents)"),
    "ocr_quality": (ocr_quality, "SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN 'unknown' WHEN doc_id % 31 = 0 THEN 'no_text' WHEN doc_id % 4 > 0 AND doc_id % 5 = 0 AND doc_id % 7 >= 2 THEN 'low' WHEN doc_id % 4 > 0 AND doc_id % 3 > 0 AND (doc_id % 10) / 10 < 0.62 THEN 'low' WHEN doc_id % 4 > 0 AND doc_id % 3 > 0 THEN 'ok' WHEN doc_id % 4 = 0 AND doc_id % 400 >= 200 THEN 'no_text' ELSE 'unknown' END AS level FROM documents"),
    "range_join_cells": (range_join_cells, "SELECT i % 10 AS image, (i * 37 % 400) // 90 AS lane, (i * 53 % 330) // 100 AS band, count(*) AS n FROM range(5000) r(i) WHERE (i * 37 % 400) < 360 AND (i * 53 % 330) < 300 GROUP BY ALL"),
    "drop_fragments": (drop_fragments, f"WITH b AS ({_BOX}) SELECT image, box FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.image = b.image AND length(b.t) < length(o.t) AND contains(o.t, b.t) AND b.x <= o.x + o.w + 10 AND o.x <= b.x + b.w + 10 AND least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y) >= 0.5 * least(b.h, o.h))"),
}
