"""Record extraction on small documents."""

import pytest
from pyspark.sql import functions as F

from fieldglass.functions.json_walk import with_records
from fieldglass.functions.pieces import text_pieces
from fieldglass.operators import classify, integrity, nested, tensors
from fieldglass.records import engineering, reports, web


def task_memory(spark, df):
    """MB that a Python worker grows by over the rows of a frame, as seen from outside."""
    import os
    import threading

    def workers():
        found = {}
        for pid in filter(str.isdigit, os.listdir("/proc")):
            try:
                with open(f"/proc/{pid}/cmdline") as command, open(f"/proc/{pid}/statm") as pages:
                    if "pyspark.daemon" in command.read():
                        found[pid] = int(pages.read().split()[1]) * 4096 / 1e6
            except OSError:
                pass
        return found

    start, peak, done = workers(), [0.0], threading.Event()

    def watch():
        while not done.wait(0.05):
            peak[0] = max(peak[0], max((mb - start.get(pid, 100) for pid, mb in workers().items()), default=0))

    watcher = threading.Thread(target=watch)
    watcher.start()
    df.write.format("noop").mode("overwrite").save()
    done.set()
    watcher.join()
    return peak[0]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, body string")


def test_can_log(spark):
    log = "\n".join(
        ["bench 4", "12.5 2 6F1 Tx d 3 01 7E C0", "12.75 CANFD 5 Rx 1A0Cx 1 0 9 0 0F 3C 99 D2", "", "13 no frame here", " 14.25 1 0b Rx d 1 FF "]
    )
    lines = engineering.can_lines(docs(spark, log), ["doc"], "body")
    assert lines.where("kind = 'header'").count() == 1
    got = [tuple(r)[1:] for r in engineering.can_events(lines, ["doc"]).orderBy("line").collect()]
    assert got == [
        ("12.5", "CAN", "2", "Tx", "6F1", "3", "01 7E C0", 2),
        ("12.75", "CANFD", "5", "Rx", "1A0Cx", "1", "0F 3C 99 D2", 3),
        ("14.25", "CAN", "1", "Rx", "0b", "1", "FF", 6),
    ]


PUMP_STATION = """\
VERSION "3"
BU_: Intake Valve Panel
 SG_ Orphan : 4|4@1+ (1,0) [0|15] "" Panel
BO_ 77 Level: 6 Intake
 SG_ Depth : 0|12@1- (0.5,2) [-10|200.25] "cm" Valve,Panel
 SG_ Alarm : 12|2@0+ (1,-3) [0|3] "" Panel
BO_ 90000 Wide: 32 Valve
CM_ BO_ 77 "first note";
VAL_ 77 Alarm 0 "none" 1 "low" 3 "dry";
VAL_ 5 Ghost 1 "y";
CM_ BO_ 77 "last note counts";"""


def test_dbc(spark):
    lines = engineering.dbc_lines(docs(spark, PUMP_STATION), ["doc"], "body")
    messages, signals = engineering.dbc_messages(lines, ["doc"]), engineering.dbc_signals(lines, ["doc"])
    level = messages.where("name = 'Level'").first()
    assert (level.message_id, level.id_hex, level.dlc, level.transmitter) == (77, "0x4D", 6, "Intake")
    assert (level.comment, level.line) == ("last note counts", 4)
    depth, alarm = [signals.where(F.col("signal") == s).first() for s in ("Depth", "Alarm")]
    assert (depth.factor, depth.maximum, depth.unit, depth.value_type) == (0.5, 200.25, "cm", "signed")
    assert (depth.receivers, depth.byte_order) == (["Valve", "Panel"], "little_endian")
    assert (alarm.message_id, alarm.value_type, alarm.offset) == (77, "unsigned", -3)
    values = engineering.dbc_values(lines, ["doc"]).where("message_id = 77").orderBy("value").collect()
    assert [(r.value, r.label) for r in values] == [(0, "none"), (1, "low"), (3, "dry")]
    assert {(r.line, r.signal) for r in engineering.dbc_warnings(lines, ["doc"]).collect()} == {(3, "Orphan"), (10, "Ghost")}

    def kept(*terms):
        rows = engineering.dbc_filter(messages, signals, ["doc"], *terms).orderBy("message_id").collect()
        return [r.message_id for r in rows]

    assert kept("Panel") == [77] and kept("Valve") == [77, 90000] and kept("", "CM") == [77] and kept("Intake", "extended") == []
    total = engineering.dbc_summary(messages, signals, ["doc"]).first()
    assert (total.messages, total.extended, total.max_dlc, total.signals) == (2, 1, 32, 3)


def test_dbc_totals_take_one_pass_and_no_window(spark):
    given = docs(spark, PUMP_STATION, "", "CM_ BO_ 5 \"no message\";", PUMP_STATION.replace("BO_ 77", "BO_ 2047"))
    lines = engineering.dbc_lines(given, ["doc"], "body")
    want = engineering.dbc_summary(engineering.dbc_messages(lines, ["doc"]), engineering.dbc_signals(lines, ["doc"]), ["doc"])
    got = engineering.dbc_totals(given, ["doc"], "body")
    assert got.columns == want.columns and len(got.collect()) == 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Generate") == 1


def test_a2l_blocks(spark):
    text = '/begin PROJECT Mill "grain"\n  /begin GROUP Rollers "r"\n/end GROUP\n/begin MEASUREMENT Gap ""'
    got = [(r.kind, r.name, r.line) for r in engineering.a2l_blocks(docs(spark, text), ["doc"], "body").collect()]
    assert got == [("PROJECT", "Mill", 1), ("GROUP", "Rollers", 2), ("MEASUREMENT", "Gap", 4)]


def test_step_file(spark):
    def step(name_arguments):
        return docs(spark, f"HEADER;\nFILE_NAME({name_arguments});\nFILE_SCHEMA(('SHAPES'));\nENDSEC;\nDATA;\n#8 = circle(#3,2.5);\nENDSEC;")

    full, bare = step("'gear','2019-03-07',('a','b'),$,'v3','cad',$"), step("$,'2019-03-07',('a'),('b'),'','',''")
    assert [tuple(r)[1:] for r in engineering.step_entities(full, ["doc"], "body").collect()] == [("#8", "CIRCLE", 6)]
    head = engineering.step_header(full, ["doc"], F.col("body")).first()
    assert (head.name, head.timestamp, head.schema) == ("gear", "2019-03-07", "SHAPES")
    head = engineering.step_header(bare, ["doc"], F.col("body")).first()
    assert (head.name, head.timestamp) == (None, "2019-03-07")


def test_arxml_and_reqif(spark):
    arxml = docs(
        spark,
        '<AUTOSAR xmlns="urn:own"><AR-PACKAGE><SHORT-NAME>Doors</SHORT-NAME><PDU><SHORT-NAME>Latch</SHORT-NAME></PDU>'
        '<PDU-REF DEST="PDU">/Doors/Latch</PDU-REF></AR-PACKAGE></AUTOSAR>',
    )
    refs = [tuple(r)[1:] for r in engineering.arxml_references(arxml, ["doc"], F.col("body")).collect()]
    assert refs == [("PDU-REF", "PDU", "/Doors/Latch")]
    names = {(r.kind, r.name) for r in engineering.arxml_elements(arxml, ["doc"], F.col("body")).collect()}
    assert ("AR-PACKAGE", "Doors") in names
    reqif = docs(spark, '<REQ-IF-HEADER IDENTIFIER="r7"><TITLE>Lifts</TITLE></REQ-IF-HEADER><SPECIFICATION IDENTIFIER="q" LONG-NAME="Cabin &lt;A&gt;"/>')
    assert [tuple(r)[1:] for r in engineering.reqif_elements(reqif, ["doc"], F.col("body")).collect()] == [("SPECIFICATION", "q", "Cabin <A>")]
    assert engineering.reqif_header(reqif, ["doc"], F.col("body")).first().title == "Lifts"


def test_trace_pairs(spark):
    marks = [("B", 0), ("B", 1), ("E", 2), ("B", 3), ("E", 4), ("E", 5), ("E", 6), ("B", 7), ("E", 9), ("B", 10)]
    names = iter("abcde")
    items = ",".join('{"name":"%s","ph":"%s","pid":1,"tid":1,"ts":%d}' % (next(names) if p == "B" else "", p, t) for p, t in marks)
    events = web.trace_events(docs(spark, '{"traceEvents":[%s]}' % items), ["doc"], F.col("body"))
    for bucket_rows in (1_000_000, 3):
        got = sorted((r.name, r.start, r.dur) for r in web.trace_spans(events, ["doc"], bucket_rows).collect())
        assert got == [("a", 0.0, 5.0), ("b", 1.0, 1.0), ("c", 3.0, 1.0), ("d", 7.0, 2.0)]
    more = docs(spark, '{"traceEvents":[%s]}' % items, '{"traceEvents":[]}', "{", '{"traceEvents":null}')
    got = sorted((r.doc, r.name, r.start, r.dur) for r in web.trace_document_spans(more, ["doc"], F.col("body")).collect())
    assert [g[1:] for g in got] == [("a", 0.0, 5.0), ("b", 1.0, 1.0), ("c", 3.0, 1.0), ("d", 7.0, 2.0)]


def test_busy_time_is_a_union(spark):
    rows = [(1, None, "a", 0.0, 10.0), (1, None, "b", 2.0, 3.0), (1, None, "c", 8.0, 4.0), (1, None, "d", 20.0, 1.0), (1, None, "e", None, 5.0)]
    rows += [(2, 7, "x", float(i), 1.5) for i in range(0, 40, 2)]
    spans = spark.createDataFrame([(0, *r) for r in rows], "d int, pid long, tid long, name string, start double, dur double")
    for bucket_rows in (1_000_000, 4):
        got = {r.pid: (r.spans, r.first, r.extent, r.busy) for r in web.trace_tracks(spans, ["d"], bucket_rows).collect()}
        assert got == {1: (5, 0.0, 21.0, 13.0), 2: (20, 0.0, 39.5, 30.0)}
    top = [(r.d, r.name, r["rank"], r.total) for r in web.trace_top_events(spans, ["d"], 2).orderBy("rank").collect()]
    assert top == [(0, "x", 1, 30.0), (0, "a", 2, 10.0)]


def test_suites_and_components_of_any_depth(spark):
    deep = "<testsuite name='a'>" + "<testsuite name='b'>" * 200 + "<testcase name='t'><![CDATA[<x>]]><failure/></testcase>" + "</testsuite>" * 201
    broken = "<testsuites><testsuite name='s'><testcase name='u'/></wrong></testsuite><testsuite name='lost'><testcase name='v'></testsuites>"
    got = sorted((r.suite, r.name, r.outcome, r.suite_path.count("/")) for r in reports.junit_cases(docs(spark, deep, broken, "", None), ["doc"], F.col("body")).collect())
    assert got == [("b", "t", "failure", 201), ("s", "u", "passed", 1)]
    inner = '{"bom-ref":"z"}'
    for i in range(100):
        inner = '{"bom-ref":"c%d","components":[%s]}' % (i, inner)
    text = '{"metadata":{"component":{"bom-ref":"main"}},"components":[%s],"dependencies":[{"ref":"main","dependsOn":["z","c99","no"]}]}' % inner
    d = docs(spark, text).withColumnRenamed("doc", "d")
    parts = reports.sbom_components(d, ["d"], F.col("body"))
    assert parts.count() == 102 and parts.where("ref = 'z'").first().path == "/components/0" * 101
    edges = reports.sbom_dependencies(d, ["d"], F.col("body"))
    assert [r.depends_on for r in reports.sbom_dangling(parts, edges, ["d"]).collect()] == ["no"]


def test_har_empty_and_broken(spark):
    got = web.har_requests(docs(spark, '{"log":{"version":"1.2","creator":{"name":"WebInspector"},"entries":[]}}', "{"), ["doc"], F.col("body"))
    assert got.count() == 0


def test_junit_outcomes(spark):
    xml = '<testsuites><testsuite name="s"><testcase name="a" classname="c" time="0.5"/><testcase name="b"><failure>f</failure><error/></testcase></testsuite></testsuites>'
    one = '<?xml version="1.0"?><testsuite name="t"><testcase name="only"><skipped/></testcase></testsuite>'
    got = sorted((r.suite, r.name, r.outcome) for r in reports.junit_cases(docs(spark, xml, one), ["doc"], F.col("body")).collect())
    assert got == [("s", "a", "passed"), ("s", "b", "error"), ("t", "only", "skipped")]


def test_geometry(spark):
    text = '{"type":"Feature","id":"x","properties":null,"geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,9]},{"type":"MultiPolygon","coordinates":[[[[0,0],[5,0],[5,5],[0,0]]]]}]}}'
    r = reports.geojson_features(docs(spark, text), ["doc"], F.col("body")).first()
    assert (r.geometry_type, r.west, r.south, r.east, r.north, r.n_vertices) == ("GeometryCollection", 0, 0, 5, 9, 5)


def test_tracks(spark):
    gpx = (
        '<gpx><trk><name>t</name><trkseg><trkpt lat="0" lon="0"><ele>5</ele><time>2024-01-01T00:00:00Z</time></trkpt>'
        '<trkpt lat="0" lon="1"><ele>9</ele><time>2024-01-01T00:01:40Z</time></trkpt></trkseg>'
        '<trkseg><trkpt lat="50" lon="50"/></trkseg></trk></gpx>'
    )
    points = reports.gpx_points(docs(spark, gpx), ["doc"], F.col("body"))
    for bucket_rows in (1_000_000, 1):
        r = reports.track_summary(points, ["doc"], bucket_rows).first()
        assert (r.points, round(r.length_m), r.elapsed_s, r.min_ele, r.max_ele, r.gain_m) == (3, 111195, 100.0, 5, 9, 4)


def test_companions(spark):
    files = spark.createDataFrame(
        [("d", "map.shp"), ("d", "MAP.dbf"), ("d", "other.dbf"), ("e", "a.shp"), ("e", "b.dbf"), ("f", "a.shp"), ("f", "x.dbf"), ("f", "y.dbf")],
        "dir string, name string",
    )
    got = {r.dir: (r.companion, r.rule) for r in integrity.companions(files, ".shp", ".dbf").collect()}
    assert got == {"d": ("MAP.dbf", "stem"), "e": ("b.dbf", "only"), "f": (None, "none")}


def test_names_resolve_by_full_or_short_name(spark):
    refs = spark.createDataFrame([("int32",), (".pkg.A",), ("B",), ("x.B",), ("pkg.Missing",)], "ref string")
    declared = spark.createDataFrame([("pkg.A",), ("pkg.B",)], "full_name string")
    missing = integrity.unresolved_names(refs, "ref", declared, "full_name", ["int32"])
    assert [r.ref for r in missing.collect()] == ["pkg.Missing"]


@pytest.mark.parametrize("shape, n", [([2, 3, 4], 24), ([], 1), ([2**40, 2**40], None), ([0, 5], 0)])
def test_element_counts(spark, shape, n):
    df = spark.createDataFrame([(shape,)], "s array<bigint>")
    assert df.select(tensors.element_count(F.col("s"))).first()[0] == n


def test_dialects_do_not_depend_on_nested_members(spark):
    texts = ['{"har":{"log":{"entries":[]}}}', '{"t\\u0079pe":"Point","coordinates":[1,2]}', '{"nbformat":4}', "42", "<gpxé/>", "<é1 a='b'/>"]
    got = [r[0] for r in docs(spark, *texts).orderBy("doc").select(classify.document_dialect(F.col("body"))).collect()]
    assert got == ["json", "geojson", "json", None, "xml", "xml"]


def test_json_table(spark):
    text = '[{"b":1,"a":"x"},{"a":null,"c":{"d":[1]}},7]'
    got = docs(spark, text).select(nested.json_to_csv(F.col("body"))).first()[0]
    assert got == '"b","a","c"\n"1","x",""\n"","","{""d"":[1]}"'



def test_batches_are_cut_by_size():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": list(range(6)), "t": ["aaaa", None, "bb", "c" * 50, "", "ddd"]})
    cut = [p.column(0).to_pylist() for p in text_pieces(batch, most=6)]
    assert cut == [[0, 1, 2], [3], [4, 5]]
    assert list(text_pieces(batch.slice(0, 0))) == []


def test_suites_of_a_large_batch_in_bounded_memory(spark):
    """A thousand reports of 25 KB come in one batch; all their elements at once would take over 500 MB."""
    cases = "".join(f"<testcase name='{i}' time='1'></testcase>" for i in range(600))
    given = spark.range(0, 1000, 1, 1).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("<testsuite name='s'>" + cases), "id", F.lit("</testsuite>")).alias("body")
    )
    peak = task_memory(spark, reports.junit_cases(given, ["doc_id"], F.col("body")))
    assert peak < 250


def test_components_of_a_large_batch_in_bounded_memory(spark):
    """A thousand bills of 30 KB come in one batch."""
    inner = ",".join(f'{{"name":"c{i}","version":"1","purl":"p"}}' for i in range(700))
    given = spark.range(0, 1000, 1, 1).select(
        F.col("id").alias("doc_id"), F.concat(F.lit('{"n":'), "id", F.lit(',"components":[' + inner + "]}")).alias("body")
    )
    read = with_records(given, "body", "found", lambda r: not r[0] and r[1].count("/") == 2).select("doc_id", F.size("found").alias("n"))
    assert read.where("n = 700").count() == 1000
    assert task_memory(spark, read) < 250
    assert task_memory(spark, nested.node_table(given, ["doc_id"], F.col("body")).agg(F.count("path"))) < 250


def test_traces_of_a_large_batch_in_bounded_memory(spark):
    """Two thousand traces of 400 events come in one batch; their spans at once would take over 300 MB."""
    pair = '{"name":"a","ph":"B","pid":1,"tid":1,"ts":%d},{"ph":"E","pid":1,"tid":1,"ts":%d}'
    events = ",".join(pair % (10 * i, 10 * i + 4) for i in range(200))
    given = spark.range(0, 2000, 1, 1).select(
        F.col("id").alias("doc_id"), F.concat(F.lit('{"n":'), "id", F.lit(',"traceEvents":[' + events + "]}")).alias("body")
    )
    spans = web.trace_document_spans(given, ["doc_id"], F.col("body"))
    assert spans.where("dur = 4").count() == 400_000
    assert task_memory(spark, spans) < 250
