"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns the
rows that go on, written as Parquet and read again before the next stage. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkrisk.llm.common import table
from sparkrisk.llm.decontaminate import drop_contaminated
from sparkrisk.llm.exact_dedup import drop_copies
from sparkrisk.llm.language_id import keep_identified
from sparkrisk.llm.packing import pack
from sparkrisk.llm.simhash import drop_near_copies
from sparkrisk.workspace import written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found."""
    return keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), any_length=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it."""
    return pack(docs)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", distinct),
    ("simhash_near_dedup", dissimilar),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: language identification and the edit search have no SQL form; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
