"""Rules of naming, rendering, links, images and delivery, run by the library's operators over the tables."""

from __future__ import annotations

from collections.abc import Iterator
from email.message import EmailMessage
from email.policy import SMTPUTF8

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import render
from inkwell.functions import text as T
from inkwell.operators import refs, sync
from inkwell.operators.books import render_books
from inkwell.sources.decoders import decode_files
from inkwell.sources.tables import table


def _span(kind: str, text: Column, url: Column | str = "", title: Column | str = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), lit(url).alias("url"), lit(title).alias("title"))


def render_inlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph of all kinds of spans; two notes, one of them twice."""
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    spans = F.array(
        _span("text", F.concat(name, F.lit(" "))), _span("bold", kind), _span("text", F.lit(" ")), _span("italic", brand), _span("strike", F.lit("old")), _span("code", name),
        _span("note", brand), _span("link", name, F.concat(F.lit("https://example.com/"), F.col("p_partkey").cast("string")), F.when(F.col("p_size") > 25, "large").otherwise("")),
        _span("note", F.lit("second")), _span("image", kind, F.lit("a.png")), _span("note", brand),
    )
    return table(spark, sf_dir, "part").select("p_partkey", render.inlines_markdown(spans).alias("markdown"))


def _illustrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whole documents with two images each, and the files that are there: d/img/0.png to 49.png, of growing size."""
    i = F.col("doc_id").cast("string")
    tail = F.concat(F.lit("\n![fig]("), F.lit("./x/../img/"), (F.col("doc_id") % 60).cast("string"), F.lit(".png?v=1#f) mid ![a b](../gone/"), i, F.lit(".png)\nend"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d/"), i, F.lit(".md")).alias("rel"), F.concat("text", tail).alias("markdown"))
    n = F.col("p_partkey") - 1
    files = table(spark, sf_dir, "part").filter("p_partkey <= 50").select(F.concat(F.lit("d/img/"), n.cast("string"), F.lit(".png")).alias("path"), (F.col("p_partkey") * 200_000).alias("size"), F.encode(F.concat(F.lit("image "), n.cast("string")), "UTF-8").alias("content"))
    return docs, files


def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, files = _illustrated(spark, sf_dir)
    return refs.place_images(docs, files, "link").select("doc_id", F.sha2("markdown", 256).alias("sha"))


def image_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, files = _illustrated(spark, sf_dir)
    return refs.place_images(docs, files, "base64", placeholder=False).select("doc_id", F.sha2("markdown", 256).alias("sha"))


def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised texts below their images."""
    docs, files = _illustrated(spark, sf_dir)
    texts = files.filter("size % 400000 = 0").select("path", F.concat(F.lit("> "), "path").alias("quote"))
    return refs.place_images(docs, files, "link", texts).select("doc_id", F.sha2("markdown", 256).alias("sha"))


def image_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, files = _illustrated(spark, sf_dir)
    return refs.image_counts(refs.image_references(docs, files, "base64"))


def links_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the pages of three books, each in a folder; some lead nowhere, some away."""
    other = F.col("page_id") * 7 % 300
    place = lambda n, ext: F.concat(F.lit("b"), (n % 3).cast("string"), F.lit("/"), n.cast("string"), F.lit(ext))
    body = F.concat(F.lit("see [one](../"), place(other, ".htm"), F.lit("#f) and [two](http://x.example/y.htm) ![i](p.png)"))
    docs = table(spark, sf_dir, "pages").select("page_id", place(F.col("page_id"), ".md").alias("rel"), body.alias("markdown"))
    known = table(spark, sf_dir, "pages").select(place(F.col("page_id"), ".htm").alias("src"), place(F.col("page_id"), ".md").alias("out"))
    return refs.rewrite_links(docs, known).select("page_id", "markdown")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the files of three books, two of them with a table of contents: folders for even and odd numbers, a void one in each; every fifth page isn't in it."""
    i = F.col("page_id").cast("string")
    book = F.concat(F.lit("b"), (F.col("page_id") % 3).cast("string"))
    pages = table(spark, sf_dir, "pages").select(book.alias("book"), F.concat(F.lit("p/"), i, F.lit(".htm")).alias("path"), F.encode("html", "UTF-8").alias("content"), "page_id")
    entry = lambda name, local: F.concat(F.lit('<li><object type="text/sitemap"><param name="Name" value="'), name, F.lit('"><param name="Local" value="'), local, F.lit('"></object>'))
    listed = pages.filter("page_id % 5 <> 0 AND page_id % 3 < 2").withColumn("g", F.col("page_id") % 2)
    leaf = entry(F.concat(F.lit("T"), (F.col("page_id") % 40).cast("string")), F.translate("path", "/", "\\"))
    folders = listed.groupBy("book", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", leaf.alias("e")))), lambda s: s["e"]), "\n").alias("own"))
    folder = F.concat(entry(F.when(F.col("g") == 0, "even").otherwise("已废止"), F.lit("")), F.lit("<ul>"), "own", F.lit("</ul>"))
    tocs = folders.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", folder.alias("e")))), lambda s: s["e"]), "\n").alias("t"))
    tocs = tocs.select("book", F.lit("main.HHC").alias("path"), F.encode(F.concat(F.lit("<ul>"), "t", F.lit("</ul>")), "UTF-8").alias("content"))
    return pages.drop("page_id").unionByName(tocs)


def help_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pages of books go, their titles, state and hashes, and how their Markdown begins."""
    begins = F.regexp_extract("markdown", r"(?s)^(---\n.*?\n---\n\n(?:> [^\n]*\n\n)?)", 1)
    return render_books(_books(spark, sf_dir)).select("rel", "title", "toc_path", "status", "hash", begins.alias("head"))


def _mails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, texts to path and content of mails: the first text is the body, the others are attachments."""
    for batch in batches:
        paths, contents = [], []
        for conv, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mail = EmailMessage(policy=SMTPUTF8)
            mail["Subject"], mail["From"] = f"S{conv}", "a@example.com"
            mail.set_content(texts[0])
            for i, text in enumerate(texts[1:], 1):
                mail.add_attachment(text.encode(), maintype="text", subtype="plain", filename=f"{i}.txt")
            paths.append(f"{conv}.eml")
            contents.append(mail.as_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])


def mail_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations as mails, decoded: subject, manifest of the attachments, body and attachments in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    mails = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(texts.alias("texts")).mapInArrow(_mails, "path string, content binary")
    b = F.col("blocks")
    manifest = F.filter(F.flatten(F.transform(F.filter(b, lambda x: x["kind"] == "table"), lambda x: x["rows"])), lambda r: r[0] == "附件")
    paragraphs = F.array_join(F.transform(F.filter(b, lambda x: x["kind"] == "p"), lambda x: x["text"]), "\n")
    return decode_files(mails).select(
        F.split("path", r"\.")[0].cast("long").alias("conv_id"), F.get(b, F.lit(0))["text"].alias("subject"), F.coalesce(F.get(manifest, F.lit(0))[1], F.lit("")).alias("manifest"),
        F.size(F.filter(b, lambda x: (x["kind"] == "h") & (x["level"] == 3))).cast("long").alias("n_attached"), F.sha2(paragraphs, 256).alias("sha"),
    )


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lit(" \t"), F.lit("\x01"), "p_name", F.lit("\x7f\n"), "p_type", F.lit(" \r\n"))
    return table(spark, sf_dir, "part").select("p_partkey", T.file_name(messy).alias("name"))


def cut_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.repeat(F.lit("x"), (F.col("p_partkey") % 250).cast("int")), F.when(F.col("p_partkey") % 2 == 0, ".tar").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.cut_component(name).alias("name"))


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.iso_seconds(F.col("ts")).alias("at"))


def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as rows whose cells span as many columns as items were bought."""
    cell = lambda text, span: F.struct(text.alias("text"), span.cast("int").alias("colspan"))
    text = F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).otherwise(F.lit(" \t"))
    row = F.array(cell(text, F.col("l_quantity") % 5 + 1), cell(F.lit(""), F.lit(1)))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(row).alias("rows"))
    return rows.select("l_orderkey", render.table_shape(F.col("rows")).alias("s")).select("l_orderkey", F.col("s.columns").cast("long").alias("columns"), F.col("s.empty").alias("empty"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of documents: two outputs, the remote ids of some, and page hashes."""
    i = F.col("doc_id").cast("string")
    pushed = F.create_map(F.lit("a"), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), i)), F.lit("b"), F.concat(F.lit("s"), i))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array(F.concat(i, F.lit("/a.md")), F.concat(i, F.lit("/b.md"))).alias("outputs"), pushed.alias("output_docs"),
        F.create_map(F.lit("a"), F.sha1("text")).alias("page_hashes"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("s"), i, F.lit(", t"), i)).alias("remote"),
    )


def registry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested columns as JSON and back; every seventh value is broken on the way."""
    stored = sync.registry_json(_registry(spark, sf_dir)).withColumn("output_docs", F.when(F.col("doc_id") % 7 == 0, "{broken").otherwise(F.col("output_docs")))
    back = sync.registry_of_json(stored)
    return back.select("doc_id", F.array_join("outputs", "|").alias("outputs"), F.coalesce(F.try_element_at("output_docs", F.lit("b")), F.lit("none")).alias("b"), F.element_at("page_hashes", "a").alias("hash"))


def remote_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remote documents of sources that went, each once."""
    gone = _registry(spark, sf_dir).withColumnRenamed("remote", "doc_id_").select(F.col("doc_id").alias("source"), F.col("doc_id_").alias("doc_id"), "output_docs").filter("source % 5 = 1")
    return sync.vanished_documents(gone, "source")


def _page_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whole documents as pages of their source, now and before: of ten ids one is new, one gone, and one has another text."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    changed = F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now, before = d.filter("doc_id % 10 <> 1"), d.filter("doc_id % 10 <> 0").withColumn("text", changed)
    return tuple(sync.page_hashes_of(x, "source", "doc_id", "text") for x in (now, before))


def outbox_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _page_states(spark, sf_dir)
    diff = sync.page_diff(now, before, ["source", "doc_id"])
    remote = before.filter("doc_id % 4 <> 0").select("source", "doc_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("doc"))
    return sync.outbox(diff, "source", "doc_id", remote).withColumn("step", F.col("step").cast("long"))


def render_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _page_states(spark, sf_dir)
    fingerprint = F.when(F.col("source") == "src1", "old").otherwise("v2")
    on_disk = before.filter("doc_id % 6 <> 0").select("doc_id")
    return sync.render_plan(now, before.select("doc_id", "hash", fingerprint.alias("fingerprint")), on_disk, "doc_id", "v2").select("doc_id", "plan")


def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda ext: F.concat(F.col("doc_id").cast("string"), F.lit(ext)).alias("rel")
    d = table(spark, sf_dir, "documents")
    on_disk = d.select(path(".md")).unionByName(d.select(path(".png"))).unionByName(spark.createDataFrame([("_index.md",), ("lost.md",)], "rel string"))
    return sync.stale_outputs(on_disk, d.filter("doc_id % 3 <> 0").select(path(".md")), "rel", ("_index.md",))


def book_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the first order that lists them; parts that no order lists form the last chapter."""
    listed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("file"))
    return sync.chapters(listed.filter("chapter % 4 = 0"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file")), "-1").select(F.col("chapter").cast("long").alias("chapter"), F.col("at").cast("long").alias("at"), F.col("file").cast("long").alias("file"))


def upload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("a/b\\")).otherwise(""), F.lit("f"), (F.col("p_partkey") % 150).cast("string"), F.lit(".txt"), F.when(F.col("p_partkey") > 100, "x").otherwise(""))
    sent = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("/"), name).alias("name"))
    existing = table(spark, sf_dir, "part").filter("p_partkey % 5 = 0").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("file"))
    return sync.new_uploads(sent, existing).select("p_partkey", "file", "verdict")


def lane_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region as lanes of two phases."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("lanes"))
    rows = F.array(F.struct(F.lit("first").alias("label"), F.transform("lanes", lambda x: F.lower(x)).alias("cells")), F.struct(F.lit("last").alias("label"), F.transform("lanes", lambda x: F.lit("")).alias("cells")))
    title = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).otherwise("")
    return n.select("n_regionkey", render.lanes_markdown(title, F.transform("lanes", lambda x, i: F.when(i == 0, "").otherwise(x)), rows).alias("markdown"))


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as pages of two sources each, with title, banner and front matter."""
    i = F.col("doc_id")
    bodies = F.array(F.when(i % 5 == 0, "  ").otherwise(F.concat(F.when(i % 2 == 0, "# head\n").otherwise("  "), F.col("text"))), F.when(i % 3 == 0, "\nsecond").otherwise(""))
    head = F.concat(F.lit("---\nid: "), i.cast("string"), F.lit("\n---\n"))
    made = render.page_markdown(F.concat(F.lit("Title "), i.cast("string")), bodies, i % 4 == 0, head)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(made, 256).alias("sha"))


_STRIP = "E' \\t\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x1f'"
_TAIL = "chr(10) || {fig} || ' mid ' || {gone} || chr(10) || 'end'"
_FIG = "'![fig](./x/../img/' || n || '.png?v=1#f)'"
_GONE = "'（原图缺失：' || doc_id || '.png）'"
_ILL = "(SELECT doc_id, text, doc_id % 60 AS n FROM documents)"
_LINKED = "CASE WHEN n < 50 THEN '![fig](' || doc_id || '.files/' || n || '.png)' ELSE '（原图缺失：' || n || '.png）' END"
_REG = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'r' || doc_id END AS a, 's' || doc_id AS b FROM documents)"
_OLD = "(SELECT source, doc_id, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 0)"
_NEW = "(SELECT source, doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1)"

QUERIES = {
    "render_inlines": (render_inlines, "SELECT p_partkey, p_name || ' **' || p_type || '** *' || p_brand || '*~~old~~`' || p_name || '`[^1][' || p_name || '](https://example.com/' || p_partkey || CASE WHEN p_size > 25 THEN ' \"large\"' ELSE '' END || ')[^2]![' || p_type || '](a.png)[^1]' AS markdown FROM part"),
    "image_links": (image_links, f"SELECT doc_id, sha256(text || {_TAIL.format(fig=_LINKED, gone=_GONE)}) AS sha FROM {_ILL}"),
    "image_data": (
        image_data,
        f"SELECT doc_id, sha256(text || {_TAIL.format(fig=f'CASE WHEN n < 26 THEN {chr(39)}![fig](data:image/png;base64,{chr(39)} || to_base64(encode({chr(39)}image {chr(39)} || n)) || {chr(39)}){chr(39)} ELSE {_FIG} END', gone=f'{chr(39)}![a b](../gone/{chr(39)} || doc_id || {chr(39)}.png){chr(39)}')}) AS sha FROM {_ILL}",
    ),
    "image_texts": (image_texts, f"SELECT doc_id, sha256(text || {_TAIL.format(fig=_LINKED + ' || CASE WHEN n < 50 AND n % 2 = 1 THEN chr(10) || chr(10) || ' + chr(39) + '> d/img/' + chr(39) + ' || n || ' + chr(39) + '.png' + chr(39) + ' ELSE ' + chr(39) * 2 + ' END', gone=_GONE)}) AS sha FROM {_ILL}"),
    "image_verdicts": (image_verdicts, f"SELECT verdict, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT CASE WHEN n >= 50 THEN 'missing' WHEN (n + 1) * 200000 > 5242880 THEN 'oversize' ELSE 'inlined' END AS verdict, CASE WHEN n < 50 THEN (n + 1) * 200000 ELSE 0 END AS size FROM {_ILL} UNION ALL SELECT 'missing', 0 FROM documents) GROUP BY verdict"),
    "links_rewritten": (
        links_rewritten,
        "SELECT page_id, 'see [one](' || CASE WHEN o NOT IN (SELECT page_id FROM pages) THEN '../b' || o % 3 || '/' || o || '.htm' WHEN o % 3 = page_id % 3 THEN o || '.md' ELSE '../b' || o % 3 || '/' || o || '.md' END || '#f) and [two](http://x.example/y.htm) ![i](p.png)' AS markdown FROM (SELECT page_id, page_id * 7 % 300 AS o FROM pages)",
    ),
    "help_books": (
        help_books,
        "WITH p AS (SELECT page_id AS i, 'b' || page_id % 3 AS book, sha1(sha1(encode(html))) AS hash, page_id % 5 <> 0 AND page_id % 3 < 2 AS listed, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE '已废止' END AS f, 'T' || page_id % 40 AS t FROM pages), "
        "l AS (SELECT *, row_number() OVER (PARTITION BY book, f, t ORDER BY i) AS k FROM p WHERE listed), "
        "d AS (SELECT book || '/' || f || '/' || t || CASE WHEN k = 1 THEN '' ELSE '_' || k END || '.md' AS rel, t AS title, f || '/' || t AS toc_path, CASE WHEN f = 'even' THEN '现行有效' ELSE '已废止' END AS status, hash, book FROM l "
        "UNION ALL SELECT book || CASE WHEN i % 3 = 2 THEN '/' ELSE '/_未编目/' END || i || '.md', CAST(i AS VARCHAR), CASE WHEN i % 3 = 2 THEN '' ELSE '_未编目/' END || i, '现行有效', hash, book FROM p WHERE NOT listed) "
        "SELECT rel, title, toc_path, status, hash, '---' || chr(10) || 'title: \"' || title || '\"' || chr(10) || 'status: \"' || status || '\"' || chr(10) || 'toc_path: \"' || toc_path || '\"' || chr(10) || 'source_chm: \"' || book || '\"' || chr(10) || 'content_hash: \"' || hash || '\"' || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN status = '已废止' THEN '> ⚠️ **本文档已废止**，仅为历史留存，请勿作为现行依据。' || chr(10) || chr(10) ELSE '' END AS head FROM d",
    ),
    "mail_decoding": (
        mail_decoding,
        "WITH c AS (SELECT conv_id, list(text ORDER BY turn, text) AS t, list(octet_length(encode(text)) ORDER BY turn, text) AS z FROM conversations GROUP BY conv_id), "
        "s AS (SELECT *, list_transform(t, lambda x: trim(x, E' \\t\\n\\r')) AS k, list_transform(range(1, least(9, len(t))), lambda i: i || '.txt (' || CASE WHEN z[i + 1] < 1024 THEN z[i + 1] || ' B' ELSE printf('%.1f', z[i + 1] / 1024) || ' KB' END || ')') AS m FROM c) "
        "SELECT conv_id, 'S' || conv_id AS subject, array_to_string(m, '、') || CASE WHEN len(t) > 9 THEN ' 等 ' || (len(t) - 1) || ' 个' ELSE '' END AS manifest, CAST(len(list_filter(t[2:], lambda x: x <> '')) AS BIGINT) AS n_attached, sha256(array_to_string(list_filter(k, lambda x: x <> ''), chr(10))) AS sha FROM s",
    ),
    "file_names": (file_names, "SELECT p_partkey, p_name || p_type AS name FROM part"),
    "cut_components": (cut_components, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN k + 4 <= 180 THEN repeat('x', k) || '.tar' ELSE repeat('x', 175) || '.tar' END ELSE CASE WHEN k <= 180 THEN repeat('x', k) ELSE repeat('x', 179) END END AS name FROM (SELECT p_partkey, CAST(p_partkey % 250 AS INT) AS k FROM part)"),
    "iso_times": (iso_times, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS \"at\" FROM events"),
    "table_shapes": (table_shapes, "SELECT l_orderkey, CAST(max(CAST(l_quantity AS BIGINT) % 5 + 2) AS BIGINT) AS columns, bool_and(l_returnflag <> 'R') AS empty FROM lineitem GROUP BY l_orderkey"),
    "registry_round_trip": (registry_round_trip, "SELECT doc_id, doc_id || '/a.md|' || doc_id || '/b.md' AS outputs, CASE WHEN doc_id % 7 = 0 THEN 'none' ELSE 's' || doc_id END AS b, sha1(text) AS hash FROM documents"),
    "remote_deletes": (remote_deletes, f"SELECT doc_id AS source, unnest(list_distinct(list_filter([CASE WHEN doc_id % 2 = 0 THEN 's' || doc_id ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN 't' || doc_id ELSE '' END, a, b], lambda x: x <> ''))) AS doc FROM {_REG} WHERE doc_id % 5 = 1"),
    "outbox_actions": (
        outbox_actions,
        f"WITH d AS (SELECT coalesce(n.source, o.source) AS source, coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'gone' WHEN n.h <> o.h THEN 'modified' ELSE 'same' END AS c, o.h IS NOT NULL AND o.doc_id % 4 <> 0 AS pushed FROM {_NEW} n FULL JOIN {_OLD} o ON n.doc_id = o.doc_id AND n.source = o.source) "
        "SELECT source, doc_id, 'put' AS action, NULL AS doc, 1 AS step FROM d WHERE c IN ('added', 'modified') UNION ALL SELECT source, doc_id, 'delete', 'r' || doc_id, 2 FROM d WHERE c IN ('modified', 'gone') AND pushed",
    ),
    "render_plans": (
        render_plans,
        f"SELECT n.doc_id, CASE WHEN o.doc_id IS NULL OR o.source = 'src1' THEN 'added' WHEN o.h <> n.h OR o.doc_id % 6 = 0 THEN 'modified' ELSE 'same' END AS plan FROM {_NEW} n LEFT JOIN {_OLD} o ON n.doc_id = o.doc_id",
    ),
    "stale_files": (stale_files, "SELECT doc_id || '.md' AS rel FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'lost.md'"),
    "book_chapters": (
        book_chapters,
        "WITH f AS (SELECT l_partkey AS file, l_orderkey AS chapter, l_linenumber AS a FROM lineitem WHERE l_orderkey % 4 = 0 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1) SELECT CAST(chapter AS BIGINT) AS chapter, CAST(a AS BIGINT) AS \"at\", CAST(file AS BIGINT) AS file FROM f UNION ALL SELECT -1, NULL, p_partkey FROM part WHERE p_partkey NOT IN (SELECT file FROM f)",
    ),
    "upload_verdicts": (
        upload_verdicts,
        "SELECT p_partkey, file, CASE WHEN file IN (SELECT 'f' || p_partkey || '.txt' FROM part WHERE p_partkey % 5 = 0) OR row_number() OVER (PARTITION BY file ORDER BY p_partkey) > 1 THEN 'skipped' ELSE 'uploaded' END AS verdict FROM (SELECT p_partkey, 'f' || p_partkey % 150 || '.txt' || CASE WHEN p_partkey > 100 THEN 'x' ELSE '' END AS file FROM part)",
    ),
    "lane_tables": (
        lane_tables,
        "SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN '**R' || n_regionkey || '**' || chr(10) || chr(10) ELSE '' END || '[图形结构：泳道图还原为下表，行=阶段，列=部门]' || chr(10) || chr(10) || '| 阶段 \\ 部门 | — | ' || array_to_string(l[2:], ' | ') || ' |' || chr(10) || '| --- |' || repeat(' --- |', len(l)) || chr(10) || '| **first** | ' || lower(array_to_string(l, ' | ')) || ' |' || chr(10) || '| **last** | ' || repeat(' | ', len(l) - 1) || ' |' AS markdown FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1)",
    ),
    "book_pages": (
        book_pages,
        f"SELECT doc_id, sha256('---' || chr(10) || 'id: ' || doc_id || chr(10) || '---' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '> ⚠️ **本文档已废止**，仅为历史留存，请勿作为现行依据。' || chr(10) || chr(10) ELSE '' END || CASE WHEN b = '' THEN '（本条目对应的 HTML 内容为空或无法解析）' WHEN starts_with(b, '# ') THEN b ELSE '# Title ' || doc_id || chr(10) || chr(10) || b END) AS sha "
        f"FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN '' ELSE trim(CASE WHEN doc_id % 2 = 0 THEN '# head' || chr(10) ELSE '  ' END || text, {_STRIP}) END, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE '' END], lambda x: x <> ''), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS b FROM documents)",
    ),
}
