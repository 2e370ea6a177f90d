"""Integers out of a hex string.

A binary column is turned to hex once; every field after that is a substring
and a base conversion, with offsets that may be columns themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def digits(hexed: Column, offset: Column | int, size: Column | int) -> Column:
    """The hex digits of ``size`` bytes at a byte offset."""
    if isinstance(offset, int):
        return F.substring(hexed, F.lit(offset * 2 + 1), _col(size) * 2)
    # An offset read from damaged data may leave the integer range: null then.
    return F.substring(hexed, (offset * 2 + 1).try_cast("int"), _col(size) * 2)


def _number(hex_digits: Column, size: int) -> Column:
    value = F.conv(hex_digits, 16, 10).cast("long")
    return F.when(F.length(hex_digits) == size * 2, value)


def _swapped(hexed: Column, offset: Column | int, size: int) -> Column:
    at = _col(offset)
    return F.concat(*[digits(hexed, at + i, 1) for i in reversed(range(size))])


def u8(hexed: Column, offset: Column | int) -> Column:
    return _number(digits(hexed, offset, 1), 1)


def u16be(hexed: Column, offset: Column | int) -> Column:
    return _number(digits(hexed, offset, 2), 2)


def u32be(hexed: Column, offset: Column | int) -> Column:
    return _number(digits(hexed, offset, 4), 4)


def u16le(hexed: Column, offset: Column | int) -> Column:
    return _number(_swapped(hexed, offset, 2), 2)


def u32le(hexed: Column, offset: Column | int) -> Column:
    return _number(_swapped(hexed, offset, 4), 4)


def i32le(hexed: Column, offset: Column | int) -> Column:
    value = u32le(hexed, offset)
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def big_endian(value: Column, size: int) -> Column:
    """Hex digits of a non-negative integer in ``size`` bytes, high byte first."""
    return F.lpad(F.hex(value.cast("long")), size * 2, "0")


def little_endian(value: Column, size: int) -> Column:
    return _swapped(big_endian(value, size), 0, size)
