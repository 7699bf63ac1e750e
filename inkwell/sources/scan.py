"""Directory scans: files below a root with their size and time, by extension and excludes, without reading their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from inkwell.functions.text import glob_pattern

# What a scan leaves out, and the formats that it takes.
EXCLUDES = ("~*", ".*", "_*", "*.tmp", "*.bak")
EXTENSIONS = (
    "ofd", "wps", "wpsx", "dpsx", "docx", "xlsx", "et", "etx", "pdf", "htm", "html", "pptx", "ppt", "dps", "doc", "xls", "gd", "rtf", "chm", "eml", "msg",
    "md", "txt", "csv", "zip", "rar", "7z", "tar", "gz", "tgz", "bz2", "tbz2", "xz", "txz", "odt",
)


IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff")


def excluded(rel: Column, patterns: tuple[str, ...] = EXCLUDES) -> Column:
    """Whether a part of the path, directories included, matches a glob."""
    if not patterns:
        return F.lit(False)
    whole = "|".join(glob_pattern(p)[1:-1] for p in patterns)
    return F.exists(F.split(rel, "/"), lambda s: s.rlike(f"^(?:{whole})$"))


def relative(path: Column, root: str) -> Column:
    """Below the root."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    return F.regexp_replace(F.substring_index(path, base + "/", -1), "^/+", "")


def files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, rel, size, modified, content; no row for a missing root. Columns that aren't used aren't read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], schema)
    return found.select("path", relative(F.col("path"), root).alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, rel and size of the image files below root."""
    return scan(spark, root, recursive, IMAGES, ()).select("path", "rel", "size")


def scan(spark: SparkSession, root: str, recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS, excludes: tuple[str, ...] = EXCLUDES) -> DataFrame:
    """Files with an allowed extension (in any case) and no excluded part, by relative path."""
    ext = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    kept = files(spark, root, recursive).filter(ext.isin([e.lower().lstrip(".") for e in extensions])).filter(~excluded(F.col("rel"), excludes))
    return kept.withColumn("ext", ext).orderBy("rel")
