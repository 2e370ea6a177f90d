"""Search, validate and classify lines as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.json_text import line_kind
from fieldglass.operators.search import search_rows


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """``(path, raw)`` for every line of the text files put into a folder."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def with_line_kind(lines: DataFrame) -> DataFrame:
    return lines.withColumn("kind", line_kind(F.col("raw")))


def search_lines(lines: DataFrame, term: str) -> DataFrame:
    return search_rows(lines, term, "")
