"""Text files as numbered lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions.formatting import utf8_text


def split_lines(text: Column) -> Column:
    """Lines of a text: any line break, a final one adds nothing, blanks stay."""
    lines = F.split(text, r"\r\n|\r|\n")
    kept = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(kept)


def document_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, line_no, raw)`` of a text column, line numbers from 1."""
    return df.select(*keys, F.posexplode(split_lines(F.col(text))).alias("_i", "raw")).select(
        *keys, (F.col("_i") + 1).cast("long").alias("line_no"), "raw"
    )


def numbered_lines(spark: SparkSession, path: str | list[str], whole: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(path, line_no, raw)`` of text files of any size, line numbers from 1.

    A file may be stored in parts, which follow each other by name (a longer number is a later part):
    ``whole`` gives the path of the file that a part belongs to.

    Files are read in splits, so one huge file is spread over many tasks. A row's id grows by one
    along its split; the least id and the number of lines of each split give the line number
    its first line has. Only those two numbers of each split are summed up and joined back; a split is read
    by one task and packed the same way in both scans, which depend on the sizes of the files alone.
    """
    ids = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("raw"),
    )
    splits = ids.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    file = whole(F.col("path")) if whole else F.col("path")
    before = Window.partitionBy(file).orderBy(F.length("path"), "path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ids.join(starts, ["path", "_block"]).select(
        file.alias("path"), (F.col("_id") + F.col("_shift") + 1).cast("long").alias("line_no"), "raw"
    )


def decoded_text(content: Column) -> Column:
    """Text of a file's bytes: UTF-16 by byte order mark, else UTF-8, mark removed."""
    head = F.hex(F.substring(content, 1, 3))
    text = (
        F.when(head.startswith("FFFE"), F.decode(content, "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(content, "UTF-16BE"))
        .otherwise(utf8_text(content))
    )
    return F.regexp_replace(text, "^\ufeff", "")


def preview(text: Column, limit: int) -> Column:
    """``struct(preview, truncated)`` of a text, cut to ``limit`` characters."""
    return F.struct(
        F.substring(text, 1, limit).alias("preview"), (F.length(text) > limit).alias("truncated")
    )
