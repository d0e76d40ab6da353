"""The corpus pipeline: language ID, line dedup, near-duplicate join, decontamination, tokenisation.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its output is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import op1_lines, op3_language, op5_jaccard, op9_bpe, op10_decontaminate
from lectern.llm.textkit import discard, keep, shared_dir, written

#: The least score with which a document's language counts as determined. On sf0.1 clean documents (quality 1) score
#: 0.49 or more and 99.9 % of them 0.53 or more; what scores less is shouting, numbers and token strings.
LANGUAGE_SCORE = 0.45


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is determined, all columns; texts that are null or have no letter go.

    Rows that repeat are judged alike and all stay; where no row has a language, no document is kept."""
    return op3_language.identified(docs, op3_language.learn(docs), LANGUAGE_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines from the texts; keeps every row, and texts that are null, empty or all boilerplate."""
    return op1_lines.without_boilerplate(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the least doc_id, and of repeated rows one.

    Texts without words, and rows without doc_id, are like no other and stay."""
    return op5_jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more lies in passages of the benchmark; texts without words stay."""
    return op10_decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoding, and the token ids of every row; a null text has none."""
    return op9_bpe.encode(docs, op9_bpe.vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("bpe", tokenise),
]

#: SQL can't express the learned, probabilistic and merging stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again.

    What a stage wrote for its own use is deleted once its output is written, and so is its predecessor's output;
    the last output stays, for the result reads it."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}/{name}"
        made.write.parquet(path)
        discard(spark, mark)
        keep(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
