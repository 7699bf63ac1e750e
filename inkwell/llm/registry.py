"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination as op8
from . import html_text as op7
from . import line_dedup as op5
from . import ngram_join as op1
from . import paragraph_dedup as op10
from . import quality_classifier as op3
from . import quality_rules as op4
from . import sentence_piece as op6
from . import suffix_dedup as op2
from . import toxicity as op9


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1.op1_ngram_join,
        "op2_suffix_dedup": op2.op2_suffix_dedup,
        "op3_quality_classifier": op3.op3_quality_classifier,
        "op4_quality_rules": op4.op4_quality_rules,
        "op5_line_dedup": op5.op5_line_dedup,
        "op6_sentence_piece": op6.op6_sentence_piece,
        "op7_html_text": op7.op7_html_text,
        "op8_decontamination": op8.op8_decontamination,
        "op9_toxicity": op9.op9_toxicity,
        "op10_paragraph_dedup": op10.op10_paragraph_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": op1.OP1_SQL, "op2_suffix_dedup": op2.OP2_SQL, "op4_quality_rules": op4.OP4_SQL, "op8_decontamination": op8.OP8_SQL}
