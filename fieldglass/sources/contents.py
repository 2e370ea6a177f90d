"""Files of any kind: listed, by their two ends, or whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.pieces import PIECE_BYTES, byte_sizes, pieces

TAIL_BYTES = 4
# The scheme and host of a path as Spark lists it.
STORE = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def read_files(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """``(path, name, size, content)`` of files; a file is read whole if its content is asked for."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        F.col("length").alias("size"),
        "content",
    )


def _place(path: str):
    """The file system of a listed path, and the path in it. A listing leaves characters as they are, where a URI escapes them."""
    import re
    from urllib.parse import quote

    from pyarrow import fs

    store = re.match(STORE, path).group()
    return fs.FileSystem.from_uri(store + quote(path[len(store) :]))


def opens_in_parts(files: DataFrame) -> bool:
    """Whether Arrow has a file system for each store of the files, so that a part of a file can be read."""
    for row in files.select(F.regexp_extract("path", STORE, 0).alias("store")).distinct().collect():
        try:
            _place(f"{row['store']}/")
        except (pa.ArrowException, OSError):
            return False
    return True


def with_ends(files: DataFrame, head_bytes: int) -> DataFrame:
    """Add ``head`` and ``tail``, the leading and the last bytes of the files; nothing else of them is read."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [min(n, head_bytes) for n in batch.column("size").to_pylist()]
            for piece in pieces(batch, sizes, PIECE_BYTES):
                heads, tails = [], []
                for path in piece.column("path").to_pylist():
                    store, inner = _place(path)
                    with store.open_input_file(inner) as handle:
                        heads.append(handle.read(head_bytes))
                        handle.seek(max(handle.size() - TAIL_BYTES, 0))
                        tails.append(handle.read(TAIL_BYTES))
                columns = [*piece.columns, pa.array(heads, pa.binary()), pa.array(tails, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, "head", "tail"])

    added = [T.StructField("head", T.BinaryType()), T.StructField("tail", T.BinaryType())]
    return files.mapInArrow(ends, T.StructType([*files.schema.fields, *added]))


def fill_contents(files: DataFrame) -> DataFrame:
    """``content`` read whole where ``unread`` is true, and as it is elsewhere."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = byte_sizes(batch.column("content"))
            unread = batch.column("unread").to_pylist()
            sizes = [n if ask else has for n, ask, has in zip(batch.column("size").to_pylist(), unread, held, strict=True)]
            for piece in pieces(batch, sizes, PIECE_BYTES):
                contents = []
                for path, ask, content in zip(*(piece.column(c).to_pylist() for c in ("path", "unread", "content")), strict=True):
                    if ask:
                        store, inner = _place(path)
                        with store.open_input_file(inner) as handle:
                            content = handle.read()
                    contents.append(content)
                at = piece.schema.get_field_index("content")
                yield piece.set_column(at, "content", pa.array(contents, pa.binary()))

    return files.mapInArrow(fill, files.schema).drop("unread")
