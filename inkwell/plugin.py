"""What a session can call by name once `register` has run: the decoder as a table function, text rules as functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from inkwell.sources.decoders import decoded


@udtf(returnType="path string, kind string, at int, block string, level int, text string, rows array<array<string>>, error string")
class Decode:
    """SELECT * FROM inkwell_decode(path, content): a row a block of a file, or of each file in an archive; a row with its error for one that can't be read."""

    def eval(self, path: str, content: bytes) -> Iterator[Row]:
        for name, kind, blocks, code, _ in decoded(bytes(content or b""), path or ""):
            if code or not blocks:
                yield name, kind, None, None, None, None, None, code or None
            for i, b in enumerate(blocks):
                yield name, kind, i, b.kind, b.level, b.text, b.rows, None


#: Text rules as SQL expressions over named arguments.
EXPRESSIONS = {
    "inkwell_newlines": ("text STRING", r"regexp_replace(text, '\\r\\n?', chr(10))"),
    "inkwell_squeeze": ("text STRING", r"regexp_replace(text, '\\n{4,}', repeat(chr(10), 3))"),
}


def register(spark: SparkSession) -> None:
    spark.udtf.register("inkwell_decode", Decode)
    for name, (arguments, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS STRING RETURN {body}")
