"""Operator 5: removal of multi-line chunks that occur again anywhere.

A rolling hash over the hashes of the last WINDOW lines chooses chunk boundaries, so that an insertion moves
only the boundaries next to it. Chunks of two or more lines with equal 128-bit hashes are candidates; each is
compared byte by byte with the first of them (smallest doc_id, then place), and removed if equal.

Defined results: null and empty texts have no chunk to remove and stay as they are; a chunk that occurs again
inside its own document is removed there too; rows that are alike in doc_id and text are one document and keep
or lose the same chunks; a group of any size is compared against one representative, never pair by pair; other
columns stay, n_chars follows the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key, row_of, small_batches, stash, table, tidy, with_text

WINDOW = 2
MEAN_LINES = 3
MIN_LINES = 2
HOT = 1000
SALTS = 64
COUNTS = ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")
_MASK = (1 << 64) - 1


def chunks(text: str, mean_lines: int = MEAN_LINES, window: int = WINDOW) -> list[tuple[int, list[str]]]:
    """(number of the first line, lines) of each chunk of a text."""
    lines = text.split("\n")
    found, start, past = [], 0, [0] * (window - 1)
    for i, line in enumerate(lines):
        past.append(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")))
        rolled = 0
        for h in past:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & _MASK
        past.pop(0)
        if (rolled >> 20) % mean_lines == 0 and i + 1 - start >= MIN_LINES:
            found.append((start, lines[start : i + 1]))
            start = i + 1
    if start < len(lines):
        found.append((start, lines[start:]))
    return found


def _hashed(mean_lines: int):
    names = ["_key", "doc_id", "at", "h"]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, lines in chunks(text or "", mean_lines):
                    if len(lines) >= MIN_LINES:
                        for c, v in zip(out, (key, doc, at, _digest("\n".join(lines))), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return tidy(run), "_key binary, doc_id long, at int, h binary"


def _digest(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass"))


def _fetched(mean_lines: int):
    """The bytes of the chunks that are asked for, with their hash, count and whether they are the first."""
    names = ["_key", "at", "h", "n", "is_first", "chunk"]
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            texts = batch.column(1).field("text").to_pylist()
            for key, text, asked in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                wanted = {x["at"]: x for x in asked}
                for at, lines in chunks(text or "", mean_lines):
                    if (x := wanted.get(at)) is not None:
                        for c, v in zip(out, (key, at, x["h"], x["n"], x["is_first"], "\n".join(lines)), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return tidy(run), "_key binary, at int, h binary, n long, is_first boolean, chunk string"


def removed_chunks(docs: DataFrame, rows: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """_of and gone, the first lines of the chunks to remove; rows: _key and _row, of all columns of docs."""
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = keyed.mapInArrow(*_hashed(mean_lines))
    first = F.min(F.struct("doc_id", "_key", "at"))
    often = small.groupBy("h").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).filter("n > 1").withColumnRenamed("h", "_h")
    often = stash(often, "often")  # read back, both sides of the join below are plain exchanges, whose hot partitions Spark splits
    is_first = (F.col("_key") == F.col("first._key")) & (F.col("at") == F.col("first.at"))
    asked = small.join(often, F.col("h") == F.col("_h")).groupBy("_key").agg(F.collect_set(F.struct("at", "h", "n", is_first.alias("is_first"))).alias("asked"))
    asked = asked.withColumnRenamed("_key", "_of")
    found = rows.join(asked, F.col("_key") == F.col("_of")).select("_key", "_row", "asked").mapInArrow(*_fetched(mean_lines))
    hot = F.col("n") > HOT
    others = found.filter("NOT is_first").select("_key", "at", "h", "chunk", F.when(hot, F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    salts = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    firsts = found.filter("is_first").dropDuplicates(["h"]).select(F.col("h").alias("_h"), F.col("chunk").alias("_chunk"), salts.alias("_salt"))
    same = others.join(firsts, (F.col("h") == F.col("_h")) & (F.col("salt") == F.col("_salt")) & (F.col("chunk") == F.col("_chunk")))
    return same.groupBy("_key").agg(F.collect_set("at").alias("gone")).withColumnRenamed("_key", "_of")


def _rebuilt(mean_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, facts = [], []
            for text, gone in zip(batch.column(0).field("text").to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, drop = chunks(text or "", mean_lines), set(gone or ())
                left = [x for at, lines in found if at not in drop for x in lines]
                kept.append(text if not drop else "\n".join(left))
                facts.append((sum(len(x) for _, x in found), len(found), len(drop)))
            n_lines, n_chunks, n_gone = zip(*facts, strict=True) if facts else ((), (), ())
            gone_lines = [n - (k or "").count("\n") - 1 if g else 0 for n, g, k in zip(n_lines, n_gone, kept, strict=True)]
            gone_lines = [n if g == c else x for n, c, g, x in zip(n_lines, n_chunks, n_gone, gone_lines, strict=True)]
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(n_lines, long), pa.array(n_chunks, long), pa.array(n_gone, long), pa.array(gone_lines, long)],
                ["_row", "_kept", *COUNTS],
            )

    return run


def dedup_lines(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """_row (the struct of all columns of docs), _kept (its text without repeated chunks) and counts."""
    small_batches(docs.sparkSession)
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("_key"), row_of(docs).alias("_row"))
    gone = removed_chunks(docs, rows, mean_lines)
    joined = rows.join(gone, F.col("_key") == F.col("_of"), "left").select("_row", "gone")
    kind = T.StructType([rows.schema["_row"], T.StructField("_kept", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return joined.mapInArrow(tidy(_rebuilt(mean_lines)), kind)


def filter_documents(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    return dedup_lines(docs, mean_lines).select(*with_text(F.col("_row"), docs.columns, F.col("_kept")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("_kept", F.lit(""))
    return found.select(F.col("_row.doc_id").alias("doc_id"), *COUNTS, F.sha2(kept, 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], mean_lines: int = MEAN_LINES) -> dict[int, str | None]:
    """What a loop over all chunks in order keeps; for tests."""
    seen: set[str] = set()
    out = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        left, any_gone = [], False
        for _, lines in chunks(text or "", mean_lines):
            chunk = "\n".join(lines)
            if len(lines) >= MIN_LINES and hashlib.sha256(chunk.encode()).digest() in seen:
                any_gone = True
                continue
            if len(lines) >= MIN_LINES:
                seen.add(hashlib.sha256(chunk.encode()).digest())
            left += lines
        out[doc] = "\n".join(left) if any_gone else text
    return out
