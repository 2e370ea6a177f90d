"""Operators on small tables, and their behaviour on skewed groups."""

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldglass.functions.cells import cell_text, number_or_null
from fieldglass.operators import classify, integrity, nested, ordering, profile, search
from fieldglass.sinks import export


def test_profile_counts_blanks(spark):
    df = spark.createDataFrame([("1", ""), ("2", "   "), ("", "x"), ("3", "y")], "n string, s string")
    n, s = profile.column_profile(df).orderBy("column_index").collect()
    assert (n.total, n.filled, n.blank, n.blank_share, n.is_numeric, n["mean"], n["min"], n["max"]) == (4, 3, 1, 0.25, True, 2, 1, 3)
    assert (s.blank, s.blank_share, s.is_numeric, s["mean"]) == (2, 0.5, False, None)
    empty = profile.column_profile(df.limit(0)).collect()
    assert [(r.total, r.blank_share, r.is_numeric) for r in empty] == [(0, 0.0, False)] * 2


def test_types(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-02", "x", None, "1"), (" 2e3 ", "2024-02-03T04:05:06", "", " ", "2024-01-01")],
        "a string, b string, c string, d string, e string",
    )
    kinds = [r.kind for r in profile.column_types(df).orderBy("column_index").collect()]
    assert kinds == ["number", "date", "text", "text", "text"]


def ordered(df, column, direction, kind=None):
    keys = ordering.typed_sort_keys(df, column, direction, ["i"], kind)
    return [r[column] for r in ordering.with_positions(df, keys).orderBy("pos").collect()]


def table(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i long, v string")


def test_sorts(spark):
    assert ordered(table(spark, ["10", "2", "11", "1"]), "v", "asc") == ["1", "2", "10", "11"]
    assert ordered(table(spark, ["10", "2", "11", "1"]), "v", "desc") == ["11", "10", "2", "1"]
    assert ordered(table(spark, ["10", "two", "3", "apple"]), "v", "asc") == ["3", "10", "apple", "two"]
    for direction, values in (("asc", ["a", "b", None, " "]), ("desc", ["b", "a", None, " "])):
        assert ordered(table(spark, [None, "b", " ", "a"]), "v", direction) == values
    assert ordered(table(spark, ["pear", "PEAR", "quince", "Rowan"]), "v", "asc") == ["pear", "PEAR", "quince", "Rowan"]
    assert ordered(table(spark, ["2024-03-01", "2023-12-31", "2024-01-15"]), "v", "asc") == ["2023-12-31", "2024-01-15", "2024-03-01"]


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_positions_with_a_hot_value(spark, partitions):
    """A third of the rows share one value; the places are still 0..n-1 once each."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else str(rng.randint(0, 50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, v string")
    keys = [ordering.SortKey(F.col("v"), False), ordering.SortKey(F.col("i"))]
    got = ordering.with_positions(df, keys, partitions=partitions).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(3000))
    assert [(r.i, r.v) for r in got] == sorted(sorted(rows), key=lambda r: r[1], reverse=True)


@pytest.mark.parametrize("page, expected", [(1, (0, 7)), (3, (14, 21)), (4, (21, 25)), (99, (21, 25)), (-5, (0, 7))])
@pytest.mark.parametrize("part_rows", [100_000, 4])
def test_pages(spark, page, expected, part_rows):
    df = spark.range(25).select(F.col("id").alias("i"))
    got = [r.i for r in ordering.page_slice(df, [ordering.SortKey(F.col("i"))], page, 7, part_rows=part_rows).collect()]
    assert got == list(range(*expected))


def test_pages_concatenate(spark):
    df = spark.range(23).select((F.col("id") * 7 % 23).alias("i"))
    keys = [ordering.SortKey(F.col("i"), False)]
    pages = [r.i for p in range(1, ordering.page_count(23, 5) + 1) for r in ordering.page_slice(df, keys, p, 5).collect()]
    assert pages == list(range(22, -1, -1))
    assert ordering.page_slice(df.limit(0), keys, 3, 5).count() == 0 and ordering.page_count(0, 5) == 1


@pytest.mark.parametrize("bucket_rows", [7, 10, 100_000])
def test_groups_over_buckets_agree_with_windows(spark, bucket_rows):
    rows = [(None if i % 3 else i % 7, i, None if i % 11 == 0 else i % 5 - 2) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, o long, a long")
    w = Window.partitionBy("g").orderBy("o")
    want = df.withColumn("prev_a", F.lag("a").over(w))
    got = ordering.previous_in_group(df, ["g"], ["o"], ["a"], bucket_rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    want = df.withColumn("s", F.sum("a").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = ordering.running_sum(df, ["g"], ["o"], "a", "s", bucket_rows)
    assert got.count() == 300
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_directions(spark):
    df = spark.createDataFrame([(0, "9"), (1, "10"), (2, "8")], "i int, v string")
    order = lambda d: ordering.typed_sort_keys(df, "v", d, ["i"])
    placed = lambda d: [r.i for r in ordering.with_positions(df, order(d)).orderBy("pos").collect()]
    assert (placed("asc"), placed("desc"), placed("none")) == ([2, 0, 1], [1, 0, 2], [0, 1, 2])
    with pytest.raises(ValueError):
        order("up")


def test_pages_of_equal_keys_hold_every_row_once(spark):
    df = spark.range(40).select("id", F.lit(1).alias("k"))
    keys = [ordering.SortKey(F.col("k"))]
    for part_rows in (3, 12, 100_000):
        rows = [r.id for p in range(1, 9) for r in ordering.page_slice(df, keys, p, 5, part_rows=part_rows).collect()]
        assert sorted(rows) == list(range(40))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_instants_are_shown_in_utc(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("select timestamp'2024-01-01T00:00:00Z' as t, timestamp_ntz'2024-01-01 00:00:00' as n")
        row = df.select(*[cell_text(F.col(f.name), f.dataType) for f in df.schema]).first()
        assert list(row) == ['"2024-01-01T00:00:00.000Z"'] * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_long_number_literals(spark):
    texts = ["0x" + "f" * 17, "0o" + "7" * 25, "0b" + "1" * 70, "0x", "0b2", "0X1F"]
    # Rounded once: between doubles, at the middle with and without a rest, far beyond, and too large.
    texts += ["0x2000000000000181", "0x20000000000001", "0x20000000000003", "0x2000000000000100000000000000000000000001", "0x" + "0" * 99 + "a"]
    texts += ["0b1" + "0" * 1022 + "1", "0x1" + "0" * 256, "0o" + "17" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(number_or_null(F.col("t"))).collect()]
    assert got[:6] == [float(16**17 - 1), float(8**25 - 1), float(2**70 - 1), None, None, 31.0]
    assert got[6:] == [float(int(t, 0)) if len(t) != 259 else None for t in texts[6:]]


def test_minify_keeps_every_character(spark):
    texts = ['{ "a" : "x\ufdd0y\ufdd1" }', '[ "\\\\" , " \\" q " ]', '"a b"', "[1,"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(nested.minified_json(F.col("t"))).collect()]
    assert got == ['{"a":"x\ufdd0y\ufdd1"}', '["\\\\"," \\" q "]', '"a b"', None]


def test_invalid_deep_text_does_not_deepen_the_plan(spark):
    df = spark.createDataFrame([(0, "[" * 400), (1, '{"a":[1]}')], "i int, t string")
    assert nested.max_depth(df, F.col("t")) == 2


def test_duplicate_numbers(spark):
    df = spark.createDataFrame([("M", 1, "first", 1), ("M", 1, "second", 2), ("M", 2, "x", 3), ("N", 1, "y", 4)], "p string, n int, name string, line int")
    for bucket_rows in (1_000_000, 1):
        got = integrity.duplicate_numbers(df, "p", "n", "name", ["line"], bucket_rows).collect()
        assert [(r.p, r.n, r.holder, r.repeat) for r in got] == [("M", 1, "first", "second")]


def test_search_is_literal_and_skips_impossible_columns(spark):
    df = spark.createDataFrame([(10, 2.5, "a%b"), (7, None, "axb")], "i int, d double, s string")
    assert [r.i for r in search.search_rows(df, "A%").collect()] == [10]
    assert [r.i for r in search.search_rows(df, "null").collect()] == [7]
    assert search.search_rows(df, "null", "").count() == 0
    assert search.search_rows(df, "").count() == 2
    assert [r.i for r in search.search_rows(df, "2.5").collect()] == [10]
    assert "i#" not in search.row_matches(df, "xb")._jc.toString() and "d" not in search.row_matches(df, "xb", "")._jc.toString().split("(")


def nodes_of(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, body string")
    return nested.node_table(df, ["id"], F.col("body")).orderBy("place")


def test_node_tables(spark):
    assert [(r.key, r.kind, r.primitive) for r in nodes_of(spark, "42").collect()] == [("$", "number", "42")]
    got = [(r.path, r.parent_path, r.kind, r.primitive, r.depth) for r in nodes_of(spark, '{"a":{"b":[10,20]},"c~/d":"x"}').collect()]
    assert got == [
        ("", None, "object", None, 0),
        ("/a", "", "object", None, 1),
        ("/a/b", "/a", "array", None, 2),
        ("/a/b/0", "/a/b", "number", "10", 3),
        ("/a/b/1", "/a/b", "number", "20", 3),
        ("/c~0~1d", "", "string", '"x"', 1),
    ]
    kinds = [r.kind for r in nodes_of(spark, '[{},[],"s",1.5,true,null]').collect()]
    assert kinds == ["array", "object", "array", "string", "number", "boolean", "null"]
    assert nodes_of(spark, "not json").count() == 0


def test_a_deep_document_beside_small_ones(spark):
    deep = '{"a":[' * 200 + "1" + "]}" * 200
    df = spark.createDataFrame([(0, deep), (1, '{"x":1}'), (2, "[" * 400), (3, None)], "id int, body string")
    start = time.perf_counter()
    nodes = nested.node_table(df, ["id"], F.col("body")).collect()
    pretty = {r.id: r.pretty for r in nested.pretty_json(df, ["id"], F.col("body")).collect()}
    assert time.perf_counter() - start < 10
    assert [max((n.depth for n in nodes if n.id == i), default=None) for i in range(4)] == [400, 1, None, None]
    assert max((n.path for n in nodes if n.id == 0), key=len) == "/a/0" * 200
    assert json.loads(pretty[0]) == json.loads(deep) and pretty[2] is None and pretty[3] is None
    assert pretty[0] == json.dumps(json.loads(deep), indent=2)


def test_repeated_keys_and_escapes(spark):
    text = '{"b":{"x":[1,2]},"a\\u0041\\n":"q\\"","b":{"y":1.50,"y":-0},"c":[]}'
    assert [(r.path, r.primitive, r.ordinal) for r in nodes_of(spark, text).collect()] == [
        ("", None, 0), ("/aA\n", '"q\\""', 0), ("/b", None, 1), ("/b/y", "0", 0), ("/c", None, 2)
    ]
    one = spark.createDataFrame([('[{"z":1,"a":2},5,{"m":[1],"z":null}]',), ('{"q":1,"c":"x"}',), ("7",), ("x",)], "t string")
    assert [r[0] for r in one.select(nested.json_to_csv(F.col("t"))).collect()] == [
        '"z","a","m"\n"1","2",""\n"","","[1]"', '"q","c"\n"1","x"', "", None
    ]


def test_deep_tree_search(spark):
    def tree(depth):
        return '{"name":"leaf","value":%d}' % depth if depth == 0 else '{"children":[%s,%s]}' % (tree(depth - 1), tree(depth - 1))

    nodes = nodes_of(spark, tree(5))
    matches = nested.search_nodes(nodes, " VALUE ")
    assert matches.count() == 32
    assert nested.search_nodes(nodes, "  ").count() == 0
    above = nested.match_ancestors(matches, ["id"])
    # 63 objects hold or lead to a match, 31 arrays lie between them.
    assert above.count() == 63 + 31 and above.where("path = ''").count() == 1


def test_conversions(spark):
    doc = '{"b":[1,{"x":null}],"a":"q\\"<","e":[],"f":{}}'
    df = spark.createDataFrame([(1, doc)], "id int, body string")
    body = F.col("body")
    assert nested.pretty_json(df, ["id"], body).first().pretty == (
        '{\n  "b": [\n    1,\n    {\n      "x": null\n    }\n  ],\n  "a": "q\\"<",\n  "e": [],\n  "f": {}\n}'
    )
    assert nested.json_to_yaml(df, ["id"], body).first().yaml == 'b: \n  - 1\n  - \n    x: null\na: "q\\"<"\ne: \n\nf: \n'
    assert nested.json_to_xml(df, ["id"], body).first().xml == (
        "<root><b><item>1</item><item><x></x></item></b><a>q&quot;&lt;</a><e></e><f></f></root>"
    )
    canonical = df.select(nested.canonical_json(body).alias("c")).withColumn("again", nested.canonical_json(F.col("c"))).first()
    assert canonical.c == canonical.again == '{"a":"q\\"<","b":[1,{"x":null}],"e":[],"f":{}}'
    loose = spark.createDataFrame([('{ "a b" : "x \\" y\\\\" , "c":[ 1 ,2 ] }',)], "t string")
    assert loose.select(nested.minified_json(F.col("t"))).first()[0] == '{"a b":"x \\" y\\\\","c":[1,2]}'


@pytest.mark.parametrize(
    "text, offset, at",
    [("hello\nworld", 0, (1, 1)), ("hello\nworld", 6, (2, 1)), ("a\r\nb", 3, (2, 1)), ("a\r\nb", 2, (2, 1)), ("ab", -1, (1, 1)), ("ab", 999, (1, 1)), ("a\n\nbc", 4, (3, 2))],
)
def test_offsets(spark, text, offset, at):
    df = spark.createDataFrame([(text, offset)], "t string, o int")
    assert tuple(df.select(nested.line_and_column(F.col("t"), F.col("o")).alias("p")).first().p) == at


def test_unique_headers():
    assert export.unique_headers(["a", "", "a", "a_2", None, "a"]) == ["a", "Column 2", "a_2", "a_2_2", "Column 5", "a_3"]
    assert export.tsv_header(["a\tb", 'c"']) == '"a\tb"\t"c"""'


def test_edits(spark):
    lines = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "line_no long, raw string")
    edits = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (9, 1, "lost")], "line_no long, edit_no int, new_raw string")
    got = integrity.apply_edits(lines, edits, ["line_no"]).orderBy("line_no").collect()
    assert [r.raw for r in got] == ["x", "new", "z"]


def kind_of(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(classify.text_kind(F.col("t"))).collect()]


def test_text_kinds(spark):
    cases = {
        '{"a":1}\n{"a":2}': "jsonl",
        '{"log":{"entries":[]}}': "har",
        '{"a":\n1}': "json",
        "<!-- c --><!DOCTYPE html><p>": "html",
        '<?xml version="1.0"?><note/>': "xml",
        "[server]\nport = 1": "toml",
        "% licence\n\\documentclass{article}": "latex",
        "%% note\nflowchart TD": "mermaid",
        "@startuml\nA -> B": "plantuml",
        "a;b\n1;2": "csv",
        "just words": None,
        "  \n ": None,
    }
    assert kind_of(spark, *cases) == list(cases.values())


def test_file_signatures(spark):
    ustar = bytearray(512)
    ustar[257:262] = b"ustar"
    font = b"OTTO" + bytes([0, 1]) + bytes(6) + b"CFF " + bytes(4) + (28).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"data"
    word = lambda n: n.to_bytes(4, "big")
    record = lambda tag, at, stored, full: tag + word(at) + word(stored) + word(full) + bytes(4)
    woff = b"wOFF" + word(0x10000) + word(88) + bytes([0, 2, 0, 0]) + word(60) + bytes(24)
    woff += record(b"cmap", 84, 2, 4) + record(b"glyf", 86, 2, 9) + b"data"
    schema = pa.schema([("a", pa.int8()), ("b", pa.list_(pa.string()))]).serialize().to_pybytes()
    cases = [
        ("stream", schema + b"more", "arrow"),
        ("cut stream", schema[:-8], "audio"),
        ("batch", pa.record_batch({"a": [1]}).serialize().to_pybytes(), "audio"),
        ("woff", woff, "font"),
        ("cut woff", woff[:-1], "unknown"),
        ("unordered", font[:4] + bytes([0, 2]) + bytes(6) + (b"cmap" + bytes(12)) + (b"CFF " + bytes(12)), "unknown"),
        ("a.tar", bytes(ustar), "archive"),
        ("plain.txt", b"true story, OTTO", "text"),
        ("f", font, "font"),
        ("x.parquet", b"PAR1" + bytes(8) + b"PAR1", "parquet"),
        ("broken.parquet", b"PAR1" + bytes(12), "parquet"),
        ("scan.json", b'{"version":"2.1.0","runs":[]}', "sarif"),
        ("route.xml", b'<gpx xmlns="http://www.topografix.com/GPX/1/1"/>', "gps"),
        ("page", b"<html><body>", "html"),
        ("empty.html", b"", "html"),
        ("m.m4a", bytes(4) + b"ftypM4A " + bytes(4), "audio"),
        ("z.zip", b"PK\x03\x04" + b"word/document.xml", "word"),
        ("noise", bytes([1, 2, 3, 4, 5]), "unknown"),
        ("long", b'{"traceEvents":[' + b"0," * 60000 + b"0]}", "trace"),
    ]
    df = spark.createDataFrame([(n, bytearray(c), len(c)) for n, c, _ in cases], "name string, content binary, size long")
    got = {r["name"]: (r["kind"], r["by_signature"]) for r in classify.classify_files(df).collect()}
    assert {n: got[n][0] for n, _, _ in cases} == {n: k for n, _, k in cases}
    assert got["x.parquet"][1] and not got["broken.parquet"][1]


def test_ordered_lines_file(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("line_no")).withColumn("raw", F.concat(F.lit("l"), "line_no"))
    target = tmp_path / "out"
    export.write_ordered_lines(df, ["line_no"], "raw", str(target))
    text = "".join(p.read_text() for p in sorted(target.glob("part-*")))
    assert text.split() == [f"l{i}" for i in range(500)]
