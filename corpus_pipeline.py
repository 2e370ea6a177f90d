"""The corpus pipeline: documents in, packed sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and gives a frame that is written and
read again as the next stage's ``docs``. All stages but the last keep the columns
of the documents. Null texts count as empty everywhere: the quality stage judges
them like any text, near-dedup keeps one of them, and packing gives them one end
id. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldglass.llm import credentials, decontaminate, near_dedup, packing, quality
from fieldglass.llm.register import table
from fieldglass.llm.shared import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts; it learns from the labelled ones among all documents."""
    return quality.drop_rejected(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret or linked part of one replaced by its kind in brackets."""
    return credentials.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", no_benchmarks),
    ("secrets", masked_secrets),
    ("packing", packed),
]

#: Learnt weights, signatures, edit distances and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
