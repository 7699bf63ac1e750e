"""The corpus pipeline: five stages over the documents of a folder, each written and read again.

Quality rules drop documents and boilerplate lines; line dedup removes chunks that occur again; the n-gram join
leaves one document of each class of near copies; decontamination drops documents that hold benchmark items; the
last stage encodes what is left, and returns the ids and their digests instead of the columns of documents.

Defined results: null texts count as empty, and are rejected by the first stage as too short; copies and near copies
of a document leave the one with the least doc_id, and of rows that are alike one; a document whose chunks all occur
earlier goes on with an empty text; empty tables give an empty result; further columns are carried to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontamination, line_dedup, ngram_join, quality_rules, sentence_piece
from inkwell.llm.common import stash, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.filter_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_piece.encode_checked(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("decontamination", benchmark),
    ("sentence_piece", encode),
]

#: The stages of exact chunk boundaries, MinHash and tokenizing have no SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
