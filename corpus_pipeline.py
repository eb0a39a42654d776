"""A training-corpus pipeline of five stages, each a DataFrame that is written and read again.

Every stage judges each row by its own text, so null and repeated doc_ids and rows that repeat are
handled like any other, columns with other names stay as they are, and an empty table gives one.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from streamloom.llm.common import written
from streamloom.llm.decontaminate import decontaminate
from streamloom.llm.language import accepted
from streamloom.llm.line_dedup import dedup_lines
from streamloom.llm.near_dedup import drop_near_duplicates
from streamloom.llm.pieces import encode_pieces
from streamloom.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters (null and empty texts too) or between languages go."""
    return accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their sources' boilerplate lines; n_chars follows the text.

    Copies of one text count as one page, so a large group of copies keeps its text for the next stage,
    which leaves one of them.  Null texts stay null; a text of boilerplate only becomes empty.
    """
    out = dedup_lines(docs, once=True)
    if "n_chars" in docs.columns:
        changed = F.col("n_dropped") > 0
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of smallest doc_id, by shingles of five words
    (op1's four are its contract's).  Documents without words stay."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item aligns with; null and empty texts stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids, and the text that these decode to; both null where text is null."""
    return encode_pieces(docs, vocabulary("piece_bpe_32k.model"), decoded=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Compression sizes, alignments and piece ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
