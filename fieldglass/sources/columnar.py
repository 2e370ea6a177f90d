"""Columnar files: footers, row windows and Arrow tables."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOOTER_SCHEMA = (
    "path string, num_rows long, row_groups long, created_by string, size_bytes long, "
    "columns array<struct<column_index:int,column_name:string,type_label:string>>"
)


def type_label(physical: str | None, logical: dict | None) -> str:
    """Display label of a column: its logical type with parameters, else the physical one."""
    if not logical or not logical.get("Type") or logical["Type"] in ("None", "Unknown"):
        return physical or "GROUP"
    name = logical["Type"].upper()
    if name == "DECIMAL" and "precision" in logical and "scale" in logical:
        return f"DECIMAL({logical['precision']}, {logical['scale']})"
    if name in ("TIMESTAMP", "TIME"):
        # Unit spellings in footers.
        units = {"milliseconds": "MILLIS", "microseconds": "MICROS", "nanoseconds": "NANOS"}
        parts = [units.get(logical.get("timeUnit", ""), "")] + (["UTC"] if logical.get("isAdjustedToUTC") else [])
        parts = [p for p in parts if p]
        return f"{name}({', '.join(parts)})" if parts else name
    if name in ("INT", "INTEGER"):
        width = logical.get("bitWidth")
        return "INTEGER" if width is None else f"{'INT' if logical.get('isSigned', True) else 'UINT'}{width}"
    return name


def _read_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json

    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path, length in zip(batch["path"], batch["length"], strict=True):
            filesystem, inner = fs.FileSystem.from_uri(path)
            with filesystem.open_input_file(inner) as handle:
                meta = pq.ParquetFile(handle).metadata
            columns = []
            for i in range(meta.num_columns):
                c = meta.schema.column(i)
                logical = json.loads(c.logical_type.to_json()) if c.logical_type is not None else None
                columns.append(
                    {"column_index": i, "column_name": c.path, "type_label": type_label(c.physical_type, logical)}
                )
            rows.append(
                {
                    "path": path,
                    "num_rows": meta.num_rows,
                    "row_groups": meta.num_row_groups,
                    "created_by": meta.created_by,
                    "size_bytes": int(length),
                    "columns": columns,
                }
            )
        yield pd.DataFrame(rows, columns=["path", "num_rows", "row_groups", "created_by", "size_bytes", "columns"])


def footer_profile(spark: SparkSession, path: str | list[str], pattern: str = "*.parquet") -> DataFrame:
    """One row per Parquet file from its footer alone; the data is not read.

    The listing is spread over tasks by path; each task opens only the ends of
    its files.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    slots = max(spark.sparkContext.defaultParallelism, 1)
    return files.repartition(slots, "path").mapInPandas(_read_footers, FOOTER_SCHEMA)


def entry_name(path: Column, folder: str) -> Column:
    """The name of the entry of ``folder`` in which a file lies: the file's own, or that of the folder that holds its parts."""
    inner = posixpath.normpath(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder)).strip("/")
    below = rf"(?:^|/|:)\Q{inner}\E/+([^/]+)"
    return F.regexp_extract(path, below, 1)


def footer_columns(footers: DataFrame) -> DataFrame:
    return footers.select("path", F.inline("columns"))


def read_parquet_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A scan of the named columns only, in the order given."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def read_parquet_window(
    spark: SparkSession, path: str, columns: list[str], start: int, size: int, pos: str = "pos"
) -> DataFrame:
    """Rows ``start`` to ``start + size - 1`` of the files in order of their paths, as stored, with their place.

    Rows are counted per file from the footers, which also gives each file its offset;
    files outside the window are not opened, and nothing is sorted or shuffled. An empty window
    has no rows.
    """
    # No column is read for the counts.
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    wanted, before = [], 0
    for row in sorted(counts.collect(), key=lambda r: r["file"]):
        first, last = max(start - before, 0), min(start + size - before, row["n"])
        if first < last:
            wanted.append((row["file"], before, first, last))
        before += row["n"]
    table = spark.read.parquet(path)
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    inside, offset = F.lit(False), F.lit(None).cast("long")
    for name, rows_before, first, last in wanted:
        inside = inside | ((file == name) & (at >= first) & (at < last))
        offset = F.when(file == name, F.lit(rows_before).cast("long")).otherwise(offset)
    kept = table.where(file.isin([w[0] for w in wanted]) & inside) if wanted else table.limit(0)
    return kept.select(*columns, (offset + at).alias(pos))


def read_arrow(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Arrow IPC files and streams as a table; one task per file, batch by batch."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    )
    slots = max(spark.sparkContext.defaultParallelism, 1)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, ipc

        for batch in batches:
            for path in batch.column(0).to_pylist():
                filesystem, inner = fs.FileSystem.from_uri(path)
                with filesystem.open_input_file(inner) as handle:
                    if handle.read(6) == b"ARROW1":
                        handle.seek(0)
                        reader = ipc.open_file(handle)
                        for i in range(reader.num_record_batches):
                            yield reader.get_batch(i)
                    else:
                        handle.seek(0)
                        yield from ipc.open_stream(handle)

    return files.repartition(slots, "path").mapInArrow(load, schema)


def write_arrow(df: DataFrame, folder: str) -> None:
    """Write one Arrow IPC file per partition, from the tasks that hold the rows."""
    target = folder

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs, ipc

        filesystem, inner = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)
        filesystem.create_dir(inner, recursive=True)
        writer = handle = None
        rows = 0
        name = f"{inner}/part-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            if writer is None:
                handle = filesystem.open_output_stream(name)
                writer = ipc.new_file(handle, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            handle.close()
        yield pa.RecordBatch.from_pydict({"name": [name], "rows": [rows]})

    df.mapInArrow(save, "name string, rows long").agg(F.sum("rows")).collect()
