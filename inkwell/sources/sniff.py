"""File kinds from the first bytes, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.quality import let

# Magic bytes of formats, as hex.
MAGIC = {"49545346": "chm", "255044462D": "pdf", "504B0304": "zip", "D0CF11E0A1B11AE1": "ole", "7B5C727466": "rtf", "1F8B": "gz", "425A68": "bz2", "FD377A585A00": "xz", "526172211A07": "rar", "377ABCAF271C": "7z", "89504E470D0A1A0A": "png", "FFD8FF": "jpg"}
MAIL = ["from ", "retur", "deliv", "recei", "mime-"]
HTML = ["<!doctype html", "<html", "<head", "<body"]


def looks_like_csv(head: Column) -> Column:
    """At least two lines, and the same number of commas (not 0) in the first three that aren't blank."""
    lines = F.split(head, "\n", -1)
    counts = F.transform(F.filter(F.slice(lines, 1, 3), lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.translate(x, ",", "")))
    return let(counts, lambda c: (F.size(lines) >= 2) & (F.size(c) >= 2) & F.coalesce((F.array_min(c) > 0) & (F.array_min(c) == F.array_max(c)), F.lit(False)))


def sniff_head(content: Column) -> Column:
    """The kind of a file from its bytes; "bin" with a NUL in the first 64, "txt" of anything else."""
    start = F.hex(F.substring(content, 1, 64))
    text = F.lower(F.substring(content, 1, 256).cast("string"))
    out = F.lit(None).cast("string")
    cases = [(start.startswith(m), kind) for m, kind in MAGIC.items()]
    cases += [(F.substring(F.ltrim(text), 1, 16).startswith(h), "html") for h in HTML]
    cases += [(text.startswith(m), "eml") for m in MAIL]
    nul = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(start) / 2).cast("int"))), lambda i: F.substring(start, 2 * i - 1, F.lit(2)) == "00")
    cases += [(nul, "bin"), (looks_like_csv(F.substring(content, 1, 256).cast("string")), "csv")]
    for test, kind in reversed(cases):
        out = F.when(test, F.lit(kind)).otherwise(F.coalesce(out, F.lit("txt")))
    return out
