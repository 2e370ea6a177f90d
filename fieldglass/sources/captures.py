"""Packet captures as rows of raw records.

Only the walk from record to record is done in Python, one pass over a file's
bytes; everything inside a packet is worked out by column expressions later.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 4096, 1 << 22

# Capture magics with byte order and unit of the time fraction.
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", "us"),
    b"\xa1\xb2\xc3\xd4": (">", "us"),
    b"\x4d\x3c\xb2\xa1": ("<", "ns"),
    b"\xa1\xb2\x3c\x4d": (">", "ns"),
}
RECORD_SCHEMA = (
    "capture string, n long, ts_s long, ts_fraction long, unit string, cap_len long, orig_len long, "
    "record_offset long, link_type int, packet binary"
)
BLOCK_SCHEMA = (
    "capture string, n long, block_type long, block_len long, block_offset long, section int, little_endian boolean, link_type int, body binary"
)
SECTION_HEADER = 0x0A0D0D0A


def _batched(rows: Iterator[tuple], schema: str):
    """Rows of one capture after another in Arrow batches of bounded rows and bytes; the last column holds the bytes."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*[field.split() for field in schema.split(", ")], strict=True)

    def batch(held: list[tuple]):
        columns = [pa.array(values, kinds[kind]) for values, kind in zip(zip(*held, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) == BATCH_ROWS or size > BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _records(capture: str, content: bytes) -> Iterator[tuple]:
    known = MAGICS.get(content[:4])
    if known is None or len(content) < 24:
        return
    order, unit = known
    (link,) = struct.unpack_from(order + "I", content, 20)
    record = struct.Struct(order + "4I")
    at, n = 24, 0
    while at + record.size <= len(content):
        seconds, fraction, captured, original = record.unpack_from(content, at)
        start = at + record.size
        if start + captured > len(content):
            return
        n += 1
        yield capture, n, seconds, fraction, unit, captured, original, at, link, content[start : start + captured]
        at = start + captured


def _walked(content: bytes) -> Iterator[tuple]:
    """Section, byte order, kind, size and place of each block."""
    at, section, order = 0, 0, "<"
    while at + 12 <= len(content):
        if content[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            section += 1
            order = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}.get(content[at + 8 : at + 12], order)
        kind, size = struct.unpack_from(order + "2I", content, at)
        if size < 12 or at + size > len(content):
            return
        yield section, order, kind, size, at
        at += size


def _blocks(capture: str, content: bytes) -> Iterator[tuple]:
    # A section's interfaces are numbered first: a packet may stand before the interface it names.
    links: dict[int, list[int]] = {}
    for section, order, kind, size, at in _walked(content):
        if kind == 1 and size >= 20:
            links.setdefault(section, []).append(struct.unpack_from(order + "H", content, at + 8)[0])
    for n, (section, order, kind, size, at) in enumerate(_walked(content), 1):
        link = None
        if (kind == 6 and size >= 32) or (kind == 3 and size >= 16):
            number = struct.unpack_from(order + "I", content, at + 8)[0] if kind == 6 else 0
            known = links.get(section, ())
            link = known[number] if number < len(known) else None
        yield capture, n, kind, size, at, section, order == "<", link, content[at + 8 : at + size - 4]


def _walker(walk, schema: str):
    def run(batches):
        def rows():
            for batch in batches:
                for capture, content in zip(batch.column("capture"), batch.column("content"), strict=True):
                    yield from walk(capture.as_py(), content.as_py())

        yield from _batched(rows(), schema)

    return run


def pcap_records(captures: DataFrame) -> DataFrame:
    """Records of classic captures given as ``(capture, content)``."""
    return captures.select("capture", "content").mapInArrow(_walker(_records, RECORD_SCHEMA), RECORD_SCHEMA)


def pcapng_blocks(captures: DataFrame) -> DataFrame:
    """Blocks of next-generation captures given as ``(capture, content)``.

    ``link_type`` of a packet block is that of the interface it names, null if the section has no such interface.
    """
    return captures.select("capture", "content").mapInArrow(_walker(_blocks, BLOCK_SCHEMA), BLOCK_SCHEMA)


def truncated_captures(captures: DataFrame, records: DataFrame) -> DataFrame:
    """Captures whose last complete record ends before the file does.

    Files that do not start like a capture are left out.
    """
    ends = records.groupBy("capture").agg(F.max(F.col("record_offset") + 16 + F.col("cap_len")).alias("_end"))
    known = F.hex(F.substring("content", 1, 4)).isin([m.hex().upper() for m in MAGICS])
    sized = captures.where(known).select("capture", F.length("content").alias("size"))
    joined = sized.join(ends, "capture", "left")
    stop = F.coalesce("_end", F.least(F.lit(24), F.col("size")))
    return joined.where(stop != F.col("size")).select("capture", "size", stop.cast("long").alias("stopped_at"))
