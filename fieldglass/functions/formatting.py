"""Display formats and text escapes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the table size classes.
LIMITED_BYTES = 50 * 1024 * 1024
BLOCKED_BYTES = 150 * 1024 * 1024

# Two-part extensions that count as one.
COMPOUND_EXTENSIONS = (".tar.gz", ".sarif.json", ".trace.json", ".cdx.json", ".cyclonedx.json")

# Raw PCM defaults.
PCM_RATE, PCM_CHANNELS, PCM_DEPTH = 16000, 1, 16

DASH = "—"


def format_size(size: Column) -> Column:
    """Bytes in 1024 steps with one decimal above plain bytes."""
    b = size.cast("double")
    unit = lambda power, name: F.format_string(f"%.1f {name}", b / float(1024**power))
    return (
        F.when(size.isNull() | (size == 0), F.lit("0 B"))
        .when(b < 1024, F.concat(F.format_string("%.0f", b), F.lit(" B")))
        .when(b < 1024**2, unit(1, "KB"))
        .when(b < 1024**3, unit(2, "MB"))
        .otherwise(unit(3, "GB"))
    )


def _not_finite(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def format_stat(number: Column) -> Column:
    """At most four decimals, no trailing zeros; a dash when not finite."""
    x = number.cast("double")
    short = F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", "")
    return F.when(_not_finite(x), F.lit(DASH)).otherwise(short)


def format_percent(fraction: Column) -> Column:
    """A share as a percentage with at most one decimal."""
    x = fraction.cast("double") * 100
    short = F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")
    return F.when(_not_finite(x), F.lit(DASH)).otherwise(F.concat(short, F.lit("%")))


def extension_of(name: Column) -> Column:
    """Lower-case extension with its dot; known two-part extensions stay whole."""
    low = F.lower(name)
    compound = "|".join(e.replace(".", r"\.") for e in COMPOUND_EXTENSIONS)
    return F.regexp_extract(low, rf"(?s)((?:{compound})|\.[^.]*)$", 1)


def size_bucket(size: Column) -> Column:
    return (
        F.when(size >= BLOCKED_BYTES, "blocked").when(size >= LIMITED_BYTES, "limited").otherwise("small")
    )


def pcm_seconds(size: Column) -> Column:
    """Duration of a headerless 16 kHz mono 16-bit recording."""
    return size / F.lit(PCM_DEPTH / 8 * PCM_CHANNELS) / F.lit(float(PCM_RATE))


def binary_preview(content: Column) -> Column:
    """Sixteen bytes as spaced hex, with the total when there are more."""
    from fieldglass.functions.cells import hex_preview

    n = F.length(content)
    more = F.concat(F.lit("… ("), n.cast("string"), F.lit(" bytes)"))
    return F.concat(hex_preview(content), F.when(n > 16, more).otherwise(""))


def printable(latin1_text: Column) -> Column:
    return F.regexp_replace(latin1_text, r"[^\x20-\x7e]", ".")


def hex_rows(content: Column, limit: int) -> Column:
    """Array of ``(offset, hex, ascii)`` rows of sixteen bytes, up to ``limit``."""
    n = F.least(F.length(content), F.lit(limit))

    def row(i: Column) -> Column:
        start = i * 16
        chunk = F.substring(content, start + 1, F.least(F.lit(16), n - start))
        return F.struct(
            F.lpad(F.lower(F.hex(start.cast("long"))), 8, "0").alias("offset"),
            F.rtrim(F.regexp_replace(F.lower(F.hex(chunk)), "(..)", "$1 ")).alias("hex"),
            printable(F.decode(chunk, "ISO-8859-1")).alias("ascii"),
        )

    indexes = F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int"))
    return F.when(n > 0, F.transform(indexes, row)).otherwise(F.array().cast("array<struct<offset:string,hex:string,ascii:string>>"))


def hex_dump(content: Column, limit: int = 4096) -> Column:
    """Offset, padded hex and ASCII per line, then a note on what is left."""
    lines = F.transform(
        hex_rows(content, limit),
        lambda r: F.concat(r["offset"], F.lit("  "), F.rpad(r["hex"], 47, " "), F.lit("  "), r["ascii"]),
    )
    left = F.length(content) - limit
    note = F.when(left > 0, F.array(F.concat(F.lit("... ("), left.cast("string"), F.lit(" more bytes)"))))
    return F.array_join(F.concat(lines, F.coalesce(note, F.array().cast("array<string>"))), "\n")


def utf8_text(content: Column) -> Column:
    """Bytes as UTF-8 text; invalid sequences become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def looks_like_text(content: Column) -> Column:
    """No zero byte and at most two percent control bytes in the probe window."""
    probe = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    controls = F.regexp_count(probe, F.lit(r"[\x01-\x08\x0b\x0e-\x1f]"))
    return (F.length(content) == 0) | (
        (F.instr(probe, "\x00") == 0) & (controls <= F.length(probe) * 0.02)
    )


def escape_tsv(text: Column) -> Column:
    """Quote a cell that holds a tab, a line break or a quote; null is empty."""
    cell = F.coalesce(text, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike(r'[\t\r\n"]'), quoted).otherwise(cell)


def quote_csv(text: Column) -> Column:
    cell = F.coalesce(text, F.lit(""))
    return F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))


def _replace_all(text: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


# The five XML entities. The ampersand goes first when escaping
# and last when unescaping.
XML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escape_xml(text: Column) -> Column:
    return _replace_all(text, XML_ENTITIES)


def unescape_xml(text: Column) -> Column:
    return _replace_all(text, [(e, c) for c, e in reversed(XML_ENTITIES)])
