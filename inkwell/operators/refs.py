"""References in texts: links to other outputs and images, joined as rows and put back in their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.quality import let
from inkwell.functions.text import cut_component, link_target

IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)\)"
LINK = r"(?<!!)\[([^\]]*)\]\(([^)\s]+)\)"
# Bytes up to which an image is put into the text, and types by extension.
MAX_INLINE = 5 << 20
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff"}


def normal_path(path: Column) -> Column:
    """With . and .. followed; a path that leaves its top begins with .. ."""

    def step(done: Column, s: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(s.isin("", "."), done).when((s == "..") & up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(s)))

    parts = F.split(F.translate(path, "\\", "/"), "/")
    start = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, start, lambda a, s: F.when(F.size(a) == 0, F.when(s.isin("", "."), a).otherwise(F.array(s))).otherwise(step(a, s))), "/")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolved(rel: Column, ref: Column) -> Column:
    """The path from the root that a reference of the document `rel` means; null for addresses and absolute paths."""
    away = ref.rlike(r"^(?i:[a-z][a-z0-9+.-]*:|[/\\#])")
    return F.when(~away, normal_path(F.concat_ws("/", F.nullif(folder(rel), F.lit("")), link_target(ref))))


def relative_to(target: Column, rel: Column) -> Column:
    """target as a reference from the folder of rel."""

    def joined(own: Column, parts: Column) -> Column:
        same = F.zip_with(own, F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x, y: x.eqNullSafe(y))
        first = F.array_min(F.transform(same, lambda v, i: F.when(~v, i)))
        k = F.coalesce(first, F.size(own))
        return F.concat(F.repeat(F.lit("../"), (F.size(own) - k).cast("int")), F.array_join(F.slice(parts, k + 1, F.size(parts)), "/"))

    own = F.when(folder(rel) == "", F.array().cast("array<string>")).otherwise(F.split(folder(rel), "/"))
    return let(own, lambda o: joined(o, F.split(target, "/")))


def references(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """The columns of docs but text, with at (0, 1, ...), label and target of each match; pattern has two groups."""
    t, p = F.col(text), F.lit(pattern)
    found = F.arrays_zip(F.regexp_extract_all(t, p, F.lit(1)).alias("label"), F.regexp_extract_all(t, p, F.lit(2)).alias("target"))
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(found).alias("at", "_m")).select(*rest, "at", F.col("_m.label").alias("label"), F.col("_m.target").alias("target"))


def replaced(docs: DataFrame, key: str, text: str, pattern: str, made: DataFrame) -> DataFrame:
    """docs with each match put in the form that made (key, at, made) has for it; matches without one stay. One row a document moves."""
    by = made.groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("at", "made"))).alias("_made"))
    joined = docs.join(by, F.col(key) == F.col("_key"), "left")
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))

    def rebuilt(p: Column) -> Column:
        rest = F.transform(whole, lambda w, i: F.concat(F.coalesce(F.try_element_at(F.col("_made"), i), w), F.get(p, i + 1)))
        return F.concat(F.get(p, F.lit(0)), F.array_join(rest, ""))

    new = F.when(F.col("_made").isNull(), F.col(text)).otherwise(let(pieces, rebuilt))
    return joined.select(*(new.alias(c) if c == text else F.col(c) for c in docs.columns))


def rewrite_links(docs: DataFrame, known: DataFrame, source: str = "rel") -> DataFrame:
    """docs (rel, markdown) whose links to sources in known (src, out) lead to their outputs; fragments and other links stay.

    Links are meant from the place of `source`, and lead from rel; of a source with several outputs the first is taken.
    """
    refs = references(docs.select(*{"rel", source}, "markdown"), "rel", "markdown", LINK).withColumn("path", resolved(F.col(source), F.col("target")))
    outs = known.groupBy(F.col("src").alias("_src")).agg(F.min("out").alias("_out"))
    hit = refs.join(outs, F.col("path") == F.col("_src"))
    fragment = F.regexp_extract("target", r"(#.*)$", 1)
    made = F.concat(F.lit("["), "label", F.lit("]("), relative_to(F.col("_out"), F.col("rel")), fragment, F.lit(")"))
    return replaced(docs, "rel", "markdown", LINK, hit.select("rel", "at", made.alias("made")))


def image_references(docs: DataFrame, files: DataFrame, mode: str = "link", max_inline: int = MAX_INLINE) -> DataFrame:
    """rel, at, label, target, path, size, verdict (missing, linked, inlined, oversize, kept) and goal, where a linked image is copied to."""
    refs = references(docs.select("rel", "markdown"), "rel", "markdown", IMAGE).withColumn("path", resolved(F.col("rel"), F.col("target")))
    found = refs.join(files.select(F.col("path").alias("_path"), "size"), F.col("path") == F.col("_path"), "left").drop("_path")
    stem = F.regexp_replace(F.substring_index("rel", "/", -1), r"\.[^.]*$", "")
    goal = F.concat(cut_component(stem, 180), F.lit(".files/"), cut_component(F.substring_index("path", "/", -1), 120))
    there = {"link": F.lit("linked"), "base64": F.when(F.col("size") > max_inline, "oversize").otherwise("inlined")}.get(mode, F.lit("kept"))
    verdict = F.when(F.col("size").isNull(), "missing").otherwise(there)
    return found.withColumn("verdict", verdict).withColumn("goal", F.when(F.col("verdict") == "linked", goal))


def place_images(docs: DataFrame, files: DataFrame, mode: str = "link", texts: DataFrame | None = None, placeholder: bool = True, max_inline: int = MAX_INLINE) -> DataFrame:
    """docs (rel, markdown) with their images as links to copies or as data, missing ones as a note, and recognised texts (path, quote) below.

    files: path, size, and content for base64. mode none leaves the texts as they are.
    """
    if mode == "none":
        return docs
    refs = image_references(docs, files, mode, max_inline)
    address = F.col("goal")
    if mode == "base64":
        data = files.select(F.col("path").alias("_data"), F.when(F.col("size") <= max_inline, F.base64("content")).alias("_b64"))
        refs = refs.join(data, F.col("path") == F.col("_data"), "left")
        kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))
        # Spark's base64 may break lines
        address = F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace("_b64", r"\s", ""))
    if texts is not None:
        refs = refs.join(texts.select(F.col("path").alias("_text"), "quote"), F.col("path") == F.col("_text"), "left")
    else:
        refs = refs.withColumn("quote", F.lit(None).cast("string"))
    tail = F.when(F.col("quote").isNotNull(), F.concat(F.lit("\n\n"), "quote")).otherwise("")
    shown = F.concat(F.lit("!["), "label", F.lit("]("), F.coalesce(address, F.col("target")), F.lit(")"), tail)
    kept = F.concat(F.lit("!["), "label", F.lit("]("), "target", F.lit(")"))
    note = F.concat(F.lit("（原图缺失："), F.substring_index(link_target(F.col("target")), "/", -1), F.lit("）")) if placeholder else kept
    made = F.when(F.col("verdict") == "missing", note).when(F.col("verdict") == "oversize", kept).otherwise(shown)
    return replaced(docs, "rel", "markdown", IMAGE, refs.select("rel", "at", made.alias("made")))


def image_counts(refs: DataFrame) -> DataFrame:
    """verdict, n and bytes of the rows of image_references."""
    return refs.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
