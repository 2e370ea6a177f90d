"""Helpers that several training-data operators use."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.sources.scratch import new_folder


#: Spark drops the shuffle files of a statement when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write a frame below the cluster's shared folder and read it back.

    Later jobs start from the files, so a lost executor never repeats the work
    that made them, and the shuffles behind them are dropped at once.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows made from one literal, without an RDD."""
    text = json.dumps(rows)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def whole_text(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def where_text(docs: DataFrame, decide, column: str = "text") -> DataFrame:
    """The documents for whose texts ``decide(texts)`` gives true; every column stays as it is.

    ``decide`` runs in the tasks on the texts of one batch.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield batch.filter(pa.array([bool(x) for x in decide(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
