"""The eleven queries of this subpackage; `corpus_pipeline` registers the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lectern.llm import op1_lines, op2_order, op3_language, op4_warc, op5_jaccard, op6_quality, op7_pii, op8_ann, op9_bpe, op10_decontaminate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines.query,
    "op2_order": op2_order.query,
    "op3_language": op3_language.query,
    "op4_warc": op4_warc.query,
    "op5_jaccard": op5_jaccard.query,
    "op6_quality": op6_quality.query,
    "op7_pii": op7_pii.query,
    "op8_ann": op8_ann.query,
    "op9_bpe": op9_bpe.query,
    "op10_decontaminate": op10_decontaminate.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {"op1_lines": op1_lines.ORACLE, "op4_warc": op4_warc.ORACLE}
