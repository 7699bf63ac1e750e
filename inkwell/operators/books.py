"""Help books that lie unpacked in a folder: pages in the places that the table of contents gives them, with titles, marks of what is void, and links."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.render import document_markdown, page_markdown
from inkwell.operators import refs
from inkwell.sources.decoders import decode_files, toc

# Directories of what is void, pages that hold no text of their own, the folder of pages that no entry names.
VOID_MARKS = ("已废止", "废止", "作废")
SCAFFOLD = ("header", "footer", "tabstrip", "tabscript")
LEFT_OVER = "_未编目"


def safe_name(name: str, limit: int = 180) -> str:
    """A file name of at most `limit` bytes, with a hash where it is cut."""
    clean = re.sub(r'[\\/:*?"<>|\x00-\x1f\x7f]+', "_", name).strip(". ") or "未命名"
    if len(clean.encode()) <= limit:
        return clean
    return clean.encode()[: limit - 9].decode("utf-8", "ignore") + "~" + hashlib.sha1(clean.encode()).hexdigest()[:8]


def placed(entries: list[tuple[int, str, str]]) -> Iterator[tuple[str, str, str, bool, str]]:
    """(rel, title, path of titles, whether it is void, source) of the entries (depth, title, source) that have a source.

    An entry with others below it is a folder, and its own page lies in it; names that repeat in a folder are numbered.
    """
    used: dict[tuple[str, ...], dict[str, int]] = {}
    above: list[tuple[int, str, str]] = []  # depth, folder, title
    for k, (depth, title, source) in enumerate(entries):
        while above and above[-1][0] >= depth:
            above.pop()
        dirs, titles = [c for _, c, _ in above], [t for _, _, t in above]
        inner = k + 1 < len(entries) and entries[k + 1][0] > depth
        if not inner and not source:
            continue
        name = safe_name(title)
        count = used.setdefault(tuple(dirs), {})
        count[name.lower()] = count.get(name.lower(), 0) + 1
        name = name if count[name.lower()] == 1 else f"{name}_{count[name.lower()]}"
        if source and source.rpartition("/")[2].rpartition(".")[0].lower() not in SCAFFOLD:
            void = any(m in t for t in titles for m in VOID_MARKS)
            yield "/".join([*dirs, *([name] if inner else []), f"{name}.md"]), title, "/".join([*titles, title]), void, source
        if inner:
            above.append((depth, name, title))


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["book", "rel", "title", "toc_path", "void", "source"]
    for batch in batches:
        rows = [(book, *row) for book, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in placed(toc(content or b""))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        kinds = [pa.string()] * 4 + [pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _scalar(value: Column) -> Column:
    """As a JSON string, which is a YAML scalar too."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def book_documents(files: DataFrame) -> DataFrame:
    """book, rel, title, toc_path, void, source of the pages of books. files: book, path (below the book), content.

    A book's root table of contents has the fewest path parts. Pages that no entry names go to a folder of their own;
    those of a book without a table stay at its top.
    """
    low = F.lower("path")
    tocs = files.filter(low.endswith(".hhc"))
    first = F.row_number().over(Window.partitionBy("book").orderBy(F.size(F.split("path", "/")), low, "path"))
    tocs = tocs.withColumn("_k", first).filter("_k = 1")
    entries = tocs.select("book", "content").mapInArrow(_outlined, "book string, rel string, title string, toc_path string, void boolean, source string")

    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    pages = files.filter(low.rlike(r"\.html?$")).select("book", "path", stem.alias("stem")).filter(~F.lower("stem").isin(*SCAFFOLD))
    named = entries.select(F.col("book").alias("_b"), F.col("source").alias("_s")).distinct()
    left = pages.join(named, (F.col("book") == F.col("_b")) & (F.col("path") == F.col("_s")), "left_anti")
    with_toc = tocs.select(F.col("book").alias("_b"), F.lit(True).alias("_toc"))
    left = left.join(with_toc, F.col("book") == F.col("_b"), "left")
    k = F.row_number().over(Window.partitionBy("book", F.lower("stem")).orderBy("path"))
    name = F.concat("stem", F.when(k == 1, "").otherwise(F.concat(F.lit("_"), k.cast("string"))), F.lit(".md"))
    top = F.when(F.col("_toc"), f"{LEFT_OVER}/").otherwise("")
    orphans = left.select("book", F.concat(top, name).alias("rel"), F.col("stem").alias("title"), F.concat(top, "stem").alias("toc_path"), F.lit(False).alias("void"), F.col("path").alias("source"))
    return entries.unionByName(orphans)


def render_books(files: DataFrame) -> DataFrame:
    """book, rel (below a folder of the book's name), title, toc_path, status, hash and markdown of each page, with front matter, banner and links to the other pages."""
    docs = book_documents(files)
    html = files.filter(F.lower("path").rlike(r"\.html?$"))
    made = decode_files(html.select(F.concat_ws("\x1f", "book", "path").alias("path"), "content")).select(F.split("source", "\x1f").alias("s"), document_markdown(F.col("blocks")).alias("body"))
    made = made.groupBy(F.col("s")[0].alias("_b"), F.col("s")[1].alias("_s")).agg(F.first("body").alias("body"))
    marks = html.select(F.col("book").alias("_hb"), F.col("path").alias("_hs"), F.sha1(F.sha1("content")).alias("hash"))
    rows = docs.join(made, (F.col("book") == F.col("_b")) & (F.col("source") == F.col("_s")), "left").join(marks, (F.col("book") == F.col("_hb")) & (F.col("source") == F.col("_hs")), "left")
    status, digest = F.when(F.col("void"), "已废止").otherwise("现行有效"), F.coalesce("hash", F.sha1(F.lit("missing").cast("binary")))
    lines = {"title": F.col("title"), "status": status, "toc_path": F.col("toc_path"), "source_chm": F.col("book"), "content_hash": digest}
    head = F.concat(F.lit("---\n"), *(x for k, v in lines.items() for x in (F.lit(f"{k}: "), _scalar(v), F.lit("\n"))), F.lit("---\n\n"))
    page = page_markdown(F.col("title"), F.array(F.coalesce("body", F.lit(""))), F.col("void"), head)
    pages = rows.select("book", F.concat("book", F.lit("/"), "rel").alias("rel"), "title", "toc_path", status.alias("status"), digest.alias("hash"), F.concat("book", F.lit("/"), "source").alias("source"), page.alias("markdown"))
    return refs.rewrite_links(pages, pages.select(F.col("source").alias("src"), F.col("rel").alias("out")), source="source").drop("source")
