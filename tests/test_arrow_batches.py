"""Arrow batches of the decoders are bounded by their bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.plans import format_plans
from inkwell.sources.decoders import decode_files
from inkwell.sources.tables import BATCH_BYTES

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])


def test_batches_of_large_files_are_small(spark):
    files = spark.range(0, 24, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 1 << 20)), "UTF-8").alias("content"))
    spark.conf.unset(NAME)
    made = decode_files(files)
    got = files.mapInArrow(_bytes, "n long, size long").collect()
    assert sum(r.n for r in got) == 24 and max(r.size for r in got) < BATCH_BYTES + (2 << 20)
    texts = made.select("path", F.length(F.col("blocks")[0]["text"]).alias("n")).collect()
    assert {r.path: r.n for r in texts} == {f"{i}.txt": (1 << 20) + len(str(i)) for i in range(24)}


def test_smaller_batches_of_the_session_stay(spark):
    for set_, want in (("1m", "1048576"), ("64m", str(BATCH_BYTES))):
        spark.conf.set(NAME, set_)
        decode_files(spark.createDataFrame([("a.txt", b"x")], "path string, content binary"))
        assert spark.conf.get(NAME).replace("1m", "1048576").rstrip("b") == want
    spark.conf.unset(NAME)


def test_large_documents_are_packed_in_small_parts(spark, tmp_path):
    """Both steps of the query, over documents that one batch of 64 MB would hold all."""
    spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words " * 9 + "\n"), 1100).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.unset(NAME)
    out = format_plans.decode_packed(spark, str(tmp_path))
    lines = format_plans._document_lines(spark, str(tmp_path)).coalesce(1)
    assert max(r.size for r in lines.mapInArrow(_bytes, "n long, size long").collect()) < BATCH_BYTES + (1 << 20)
    got = out.collect()
    assert len(got) == 220 and len({r.text_sha for r in got if not r.error}) == 1
