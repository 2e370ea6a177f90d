"""Slices of Arrow batches for Python passes over documents.

A batch holds up to ten thousand rows, whatever their size. What a pass makes of a
document as Python objects is many times its text, so a pass takes a batch slice by
slice and hands on each slice's rows before it reads the next.
"""

from __future__ import annotations

PIECE_BYTES, PIECE_ITEMS = 1 << 20, 10_000


def pieces(batch, sizes: list[int], most: int):
    """The slices of a batch or array, in order: rows of ``most`` in all, or one larger row."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def byte_sizes(texts) -> list[int]:
    """The bytes of each text of an Arrow array; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def text_pieces(batch, column: int = -1, most: int = PIECE_BYTES):
    """The slices of a batch by the bytes of one of its columns."""
    return pieces(batch, byte_sizes(batch.column(column % batch.num_columns)), most)
