"""python -m inkwell convert SOURCE OUT STATE | watch SOURCE OUT STATE | file PATH | quality FOLDER | formats"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main() -> None:
    parser = argparse.ArgumentParser(prog="inkwell", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("convert", "watch"):
        own = commands.add_parser(name)
        for argument in ("source", "out", "state"):
            own.add_argument(argument)
    commands.add_parser("quality").add_argument("folder")
    commands.add_parser("file").add_argument("path")
    commands.add_parser("formats")
    given = parser.parse_args()
    spark = SparkSession.builder.appName("inkwell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "convert":
        from inkwell.plans.batch import run_batch

        print(json.dumps(asdict(run_batch(spark, given.source, given.out, given.state))))
    elif given.command == "watch":
        from inkwell.streaming.ingest import ingest

        ingest(spark, given.source, given.out, given.state)
    elif given.command == "file":
        from inkwell.sources.decoders import markdown_of

        for r in markdown_of(spark, given.path).toLocalIterator():
            print(r.markdown if r.error is None else f"{r.path}: {r.error}")
    elif given.command == "formats":
        from inkwell.sources.decoders import formats

        formats(spark).orderBy("name").show(100, False)
    else:
        from inkwell.functions.quality import with_quality
        from inkwell.sources.scan import files

        texts = files(spark, given.folder).filter(F.col("rel").endswith(".md")).select("rel", F.col("content").cast("string").alias("text"))
        with_quality(texts).select("rel", "score", "warnings").orderBy("rel").show(1000, False)


if __name__ == "__main__":
    main()
