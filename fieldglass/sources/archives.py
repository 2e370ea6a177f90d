"""Member listings of archives, from their directories only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.pieces import text_pieces

MEMBER_SCHEMA = "archive string, entry_path string, size long, is_directory boolean, problem string"

# What an archive may hold to count as safe.
MAX_ENTRIES = 2000
MAX_EXPANDED = MAX_ARCHIVE = 512 * 1024 * 1024


def _members(content: bytes) -> list[tuple[str, int, bool]]:
    import io
    import tarfile
    import zipfile

    stream = io.BytesIO(content)
    if content[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        with zipfile.ZipFile(stream) as z:
            return [(i.filename, i.file_size, i.is_dir()) for i in z.infolist() if i.filename]
    with tarfile.open(fileobj=stream, mode="r:*") as t:
        return [(m.name, m.size, m.isdir()) for m in t if m.name]


def _problem(content: bytes) -> str | None:
    """Why a ZIP directory cannot be trusted, from its closing record."""
    import struct

    if content[:4] not in (b"PK\x03\x04", b"PK\x05\x06"):
        return None
    at = content.rfind(b"PK\x05\x06")
    if at < 0 or at + 22 > len(content):
        return "end record missing"
    disk, first_disk, here, total, size, start, note = struct.unpack_from("<4H2IH", content, at + 4)
    if at + 22 + note != len(content):
        return "end record missing"
    if 0xFFFF in (disk, first_disk, here, total) or 0xFFFFFFFF in (size, start):
        return "zip64"
    if disk or first_disk or here != total:
        return "multi-disk"
    return None if start + size == at else "directory inconsistent"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    names = ["archive", "entry_path", "size", "is_directory", "problem"]
    for batch in batches:
        for piece in text_pieces(batch):
            rows = []
            for archive, content in zip(*piece.columns, strict=True):
                archive, data = archive.as_py(), content.as_py() or b""
                problem = _problem(data)
                try:
                    rows += [(archive, *m, problem) for m in _members(data)]
                except Exception as error:  # an unreadable archive is a result, not a failed job
                    rows.append((archive, None, None, None, problem or f"unreadable: {type(error).__name__}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def list_members(archives: DataFrame) -> DataFrame:
    """One row per member of each archive in ``(archive, content)``.

    An archive that cannot be read gives one row with its ``problem``.
    """
    return archives.select("archive", "content").mapInArrow(_list, MEMBER_SCHEMA)


def archive_files(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(path).select(F.col("path").alias("archive"), "content")


def archive_totals(members: DataFrame) -> DataFrame:
    """Entries, expanded bytes and limit flags per archive."""
    entries = F.count("entry_path")
    expanded = F.coalesce(F.sum("size"), F.lit(0))
    return members.groupBy("archive").agg(
        entries.alias("entries"),
        expanded.alias("expanded_bytes"),
        F.count_if(F.col("is_directory")).alias("directories"),
        (entries > MAX_ENTRIES).alias("too_many"),
        (expanded > MAX_EXPANDED).alias("too_large"),
        F.first("problem", ignorenulls=True).alias("problem"),
    )
