"""Cell semantics and formats on the small cases they are defined by."""

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import cells
from fieldglass.functions import formatting as fmt
from fieldglass.functions.json_text import line_kind, nesting_depth, strict_json


def column(spark, values, expr, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr(F.col("v"))).collect()]


def test_numeric_cells(spark):
    texts = ["42", "  -3.5 ", "1e3", "abc", "NaN", "", "1.2.3", "0x10", "0b11", "0o17", "1d", "Infinity", "1e999", None, ".5", "5."]
    got = column(spark, texts, cells.number_or_null)
    assert got == [42, -3.5, 1000, None, None, None, None, 16, 3, 15, None, None, None, None, 0.5, 5]


def test_blank_cells(spark):
    assert column(spark, [None, "", "   ", " \t\n", "x", " x "], cells.is_blank) == [True] * 4 + [False] * 2


@pytest.mark.parametrize(
    "number, text",
    [(17.0, "17"), (0.05, "0.05"), (-0.0, "0"), (12345678.9, "12345678.9"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (0.0001, "0.0001"), (1e7, "10000000")],
)
def test_number_text(spark, number, text):
    assert column(spark, [number], cells.number_text, "v double") == [text]


def test_natural_order(spark):
    words = ["b", "a9", "Z", "á1", "A2", "á10", "a007", "a" + "9" * 30, "a" + "1" + "0" * 30]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in df.orderBy(cells.collated(cells.natural_key(F.col("w")))).collect()]
    assert got == ["á1", "A2", "a007", "a9", "á10", "a" + "9" * 30, "a1" + "0" * 30, "b", "Z"]


def test_search_text(spark):
    df = spark.sql(
        "select cast(null as string) n, 12345678901234567 b, true t, named_struct('x', 1, 'y', cast(null as int)) s, X'00ff10' h, 2.0D d"
    )
    texts = [cells.cell_text(F.col(c), df.schema[c].dataType) for c in df.columns]
    assert list(df.select(*texts).first()) == ["null", "12345678901234567", "true", '{"x":1,"y":null}', "00 ff 10", "2"]


def test_formats(spark):
    assert column(spark, [0, 512, 1536, 5 * 1024**2, 3 * 1024**3, 2 * 1024**4], fmt.format_size, "v long") == [
        "0 B", "512 B", "1.5 KB", "5.0 MB", "3.0 GB", "2048.0 GB",
    ]
    assert column(spark, [3.0, 3.14159, 2.5, float("nan"), 100.0], fmt.format_stat, "v double") == ["3", "3.1416", "2.5", "—", "100"]
    assert column(spark, [0.25, 0.333, 1.0], fmt.format_percent, "v double") == ["25%", "33.3%", "100%"]
    mib = 1024 * 1024
    sizes = [50 * mib - 1, 50 * mib, 150 * mib - 1, 150 * mib, -1]
    assert column(spark, sizes, fmt.size_bucket, "v long") == ["small", "limited", "limited", "blocked", "small"]


def test_extensions(spark):
    names = ["a.TAR.GZ", "scan.sarif.json", "b.csv", "none", "x.y/z.txt"]
    assert column(spark, names, fmt.extension_of) == [".tar.gz", ".sarif.json", ".csv", "", ".txt"]


def test_bytes(spark):
    data = [bytearray(range(20)), bytearray(b"Hello")]
    assert column(spark, data, fmt.binary_preview, "v binary") == [
        "00 01 02 03 04 05 06 07 08 09 0a 0b 0c 0d 0e 0f… (20 bytes)", "48 65 6c 6c 6f",
    ]
    dump = column(spark, [bytearray(b"0123456789abcdefXY")], lambda c: fmt.hex_dump(c, 17), "v binary")[0]
    assert dump.split("\n") == [
        "00000000  30 31 32 33 34 35 36 37 38 39 61 62 63 64 65 66  0123456789abcdef",
        "00000010  58" + " " * 45 + "  X",
        "... (1 more bytes)",
    ]
    texts = [bytearray(b"plain\ttext\n"), bytearray(b"a\x00b"), bytearray(b"\x01" * 3 + b"a" * 97), bytearray(b"\x01" + b"a" * 99), bytearray()]
    assert column(spark, texts, fmt.looks_like_text, "v binary") == [True, False, False, True, True]


def test_tsv_cells(spark):
    assert column(spark, ["a", "a\tb", 'say "x"', "l\nm", None], fmt.escape_tsv) == ["a", '"a\tb"', '"say ""x"""', '"l\nm"', ""]


def test_line_kinds(spark):
    lines = ['{"a":1}', "[1]", "42", '"hello"', "null", "", "\t ", '{"unterminated":', '{"a":1} x', "1,2", "1],[2", '{"b":1,"b":3}']
    kinds = ["valid"] * 5 + ["empty"] * 2 + ["invalid"] * 4 + ["valid"]
    assert column(spark, lines, line_kind) == kinds
    assert column(spark, ['{"b":1,"b":3}'], lambda c: F.to_json(strict_json(c))) == ['{"b":3}']


def test_depth(spark):
    texts = ["1", "[]", '{"a":[{"b":"]]]}}"}]}', r'{"a":"\"[[["}']
    assert column(spark, texts, nesting_depth) == [0, 1, 3, 1]
