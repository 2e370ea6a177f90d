"""What a cell means: blank, numeric, searchable text, sort key.

All helpers build Catalyst expressions; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.binding import let

# The characters a browser's String.trim removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Number literals accepted as numeric text.
DECIMAL_LITERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
HEX_LITERAL = r"^0[xX][0-9a-fA-F]+$"
OCTAL_LITERAL = r"^0[oO][0-7]+$"
BINARY_LITERAL = r"^0[bB][01]+$"

# A date-like text holds one of these characters.
DATE_SHAPE = r"[-/:T]"

# Date texts accepted beside ISO 8601. Browsers accept more spellings; this
# list is the documented choice here.
DATE_FORMATS = (
    "M/d/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "yyyy/M/d",
    "yyyy/M/d H:mm:ss",
)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def trimmed(text: Column) -> Column:
    """Text without leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null and for whitespace-only text; never null."""
    return text.isNull() | (trimmed(text) == "")


def finite_or_null(number: Column) -> Column:
    value = number.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def _bits(digits: Column, base: int) -> Column:
    """The binary digits of a number written in base 2, 8 or 16, without leading zeros."""
    width = {2: 1, 8: 3, 16: 4}[base]
    runs = F.regexp_extract_all(digits, F.lit("(?s).{1,%d}" % (60 // width)), F.lit(0))
    bits = F.transform(runs, lambda r: F.lpad(F.conv(r, base, 2), F.length(r) * width, F.lit("0")))
    return F.ltrim(F.array_join(bits, ""), F.lit("0"))


def _double_of_bits(bits: Column) -> Column:
    """The double nearest to a binary number of any length, rounded once.

    Up to 63 bits are a whole number, whose cast rounds rightly. Of a longer one the
    first 62 bits count, and one more that tells whether anything follows; scaling by
    a power of two is exact.
    """
    whole = lambda b: F.conv(b, 2, 10).cast("long").cast("double")
    tail = F.substring(bits, F.lit(63), F.length(bits))
    head = F.concat(F.substring(bits, 1, 62), F.when(F.contains(tail, F.lit("1")), "1").otherwise("0"))
    return (
        F.when(bits == "", 0.0)
        .when(F.length(bits) <= 63, whole(bits))
        .otherwise(whole(head) * F.pow(F.lit(2.0), F.length(bits) - 63))
    )


def number_or_null(text: Column) -> Column:
    """The number a text spells, or null. Rejects ``1d``, ``NaN``, ``Infinity``."""
    t = trimmed(text)

    def radix(base: int) -> Column:
        return finite_or_null(let(_bits(F.substring(t, F.lit(3), F.length(t)), base), _double_of_bits))

    # Numbers start with a character from "+" to "9"; most texts end here.
    return F.when(
        (t >= "+") & (t < ":"),
        F.when(t.rlike(DECIMAL_LITERAL), finite_or_null(t.try_cast("double")))
        .when(t.rlike(HEX_LITERAL), radix(16))
        .when(t.rlike(OCTAL_LITERAL), radix(8))
        .when(t.rlike(BINARY_LITERAL), radix(2)),
    )


def timestamp_or_null(text: Column) -> Column:
    """The instant a date-shaped text spells, or null."""
    t = trimmed(text)
    parsed = F.coalesce(F.try_to_timestamp(t), *[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS])
    return F.when(t.rlike(DATE_SHAPE), parsed)


def number_text(number: Column) -> Column:
    """A double printed as a script engine prints it: ``17``, ``0.05``, ``1e+21``."""
    d = number.cast("double") + F.lit(0.0)
    java = d.cast("string")
    whole = F.when(java.endswith(".0"), F.substring(java, F.lit(1), F.length(java) - 2)).otherwise(java)
    # Small and large magnitudes are rare; binding them keeps the common path short.
    return F.when(F.contains(java, F.lit("E")), let(d, _scaled_text)).otherwise(whole)


def _scaled_text(d: Column) -> Column:
    size, java = F.abs(d), d.cast("string")
    stripped = lambda c: F.regexp_replace(c, r"\.?0+$", "")
    exponent = F.regexp_replace(F.regexp_replace(java, r"(\.0)?E(?=\d)", "e+"), r"(\.0)?E-", "e-")
    return (
        F.when((size >= 1e7) & (size < 1e21), stripped(java.try_cast("decimal(38,15)").cast("string")))
        .when((size >= 1e-6) & (size < 1e-3), stripped(java.try_cast("decimal(38,30)").cast("string")))
        .otherwise(exponent)
    )


def hex_preview(content: Column, size: int = 16) -> Column:
    """The first bytes as spaced lower-case hex."""
    digits = F.lower(F.hex(F.substring(content, 1, size)))
    return F.rtrim(F.regexp_replace(digits, "(..)", "$1 "))


def cell_text(cell: Column, dtype: T.DataType, null_text: str = "null") -> Column:
    """The text of a cell as search sees it; ``null_text`` stands for null."""
    if isinstance(dtype, T.StringType):
        text = cell
    elif isinstance(dtype, INTEGER_TYPES):
        text = cell.cast("string")
    elif isinstance(dtype, NUMERIC_TYPES):
        text = number_text(cell)
    elif isinstance(dtype, T.BooleanType):
        text = cell.cast("string")
    elif isinstance(dtype, T.BinaryType):
        text = hex_preview(cell)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        # An instant is shown in UTC, whatever the session's zone is.
        if isinstance(dtype, T.TimestampType):
            cell = F.to_utc_timestamp(cell, F.current_timezone())
        text = F.date_format(cell, "\"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"")
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(cell, {"ignoreNullFields": "false"})
    elif isinstance(dtype, T.VariantType):
        text = F.to_json(cell)
    else:
        text = cell.cast("string")
    return F.coalesce(text, F.lit(null_text))


def natural_key(text: Column) -> Column:
    """Sort text so that ``A2`` comes before ``a10`` and ``á`` sits with ``a``.

    A run of digits is written as its length (ten digits) followed by its
    significant digits, so that plain text order is numeric order whatever the
    run's length.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def encode(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        return F.when(
            run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        ).otherwise(run)

    spelled = F.array_join(F.transform(runs, encode), "")
    return F.when(text.rlike("[0-9]"), spelled).otherwise(F.lower(text))


def collated(key: Column) -> Column:
    """Compare by base letter: case and accents are ignored."""
    return F.collate(key, "UNICODE_CI_AI")
