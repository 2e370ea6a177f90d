"""Files written by the tests and read back, and captures built byte by byte."""

import io
import re
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import classify
from fieldglass.plans import files
from fieldglass.plans import records as documents
from fieldglass.records import headers, packets
from fieldglass.sources import archives, captures, columnar, contents, delimited, lines
from fieldglass.streaming.lines import search_lines, stream_lines, with_line_kind


def detect(spark, text, name=None):
    df = spark.createDataFrame([(text, name)], "t string, n string")
    got = df.select(delimited.detect_delimiter(F.col("t"), F.col("n") if name else None).alias("d")).first().d
    return got.delimiter, got.confidence


@pytest.mark.parametrize(
    "text, delimiter",
    [
        ("name,age,city\na,1,x\nb,2,y\nc,3,z", ","),
        ("a\tb\tc\n1\t2\t3\n4\t5\t6", "\t"),
        ('plant;height;remark\na;"1,50";x\nb;"2,75";y', ";"),
        ("when|where|what\r\n1|info|x\r2|warn|y", "|"),
        ("a,b\nc,d\ne,f\ng,h\n|||||||||", ","),
        ('"x\ny",1;2;3;4\n"p\nq",5', ","),
    ],
)
def test_delimiters(spark, text, delimiter):
    assert detect(spark, text)[0] == delimiter


def test_delimiter_fallbacks(spark):
    assert detect(spark, "one\ntwo") == (",", 0.0)
    assert detect(spark, "") == (",", 0.0)
    assert detect(spark, "a,b,c", "x.TSV") == ("\t", 1.0)


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path, "a.csv", '﻿name,note\n"x ""q""","l1\nl2",extra,more\r\nshort\n')
    df = delimited.read_delimited(spark, path)
    assert df.columns == ["name", "note", "Column 3", "Column 4"]
    assert [tuple(r) for r in df.collect()] == [('x "q"', "l1\nl2", "extra", "more"), ("short", "", "", "")]


def test_csv_wider_than_expected(spark, tmp_path):
    wide = ",".join(str(i) for i in range(40))
    path = write(tmp_path, "w.csv", "a,b\n" + wide + "\n")
    df = delimited.read_delimited(spark, path, has_header=False)
    assert len(df.columns) == 40 and df.columns[39] == "Column 40"
    assert df.where("`Column 40` = '39'").count() == 1


def test_line_numbers(spark, tmp_path):
    write(tmp_path, "a.jsonl", "one\r\n\r\nthree\n")
    write(tmp_path, "b.jsonl", "".join(f"{i}\n" for i in range(2000)))
    for limit in ("128MB", "1000", "37"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            got = lines.numbered_lines(spark, str(tmp_path))
            rows = sorted((r.path[-7:], r.line_no, r.raw) for r in got.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
        assert rows[:3] == [("a.jsonl", 1, "one"), ("a.jsonl", 2, ""), ("a.jsonl", 3, "three")]
        assert rows[3:] == sorted(("b.jsonl", i + 1, str(i)) for i in range(2000))


def test_line_numbers_of_parts(spark, tmp_path):
    for name in ("a", "b"):
        folder = tmp_path / f"{name}.txt"
        folder.mkdir()
        for part, first in ((99999, 0), (100000, 40)):
            write(folder, f"part-{part:05d}", "".join(f"{name}{i}\n" for i in range(first, first + 40)))
    got = lines.numbered_lines(spark, str(tmp_path / "*.txt"), lambda path: F.regexp_extract(path, "([^/]+)/[^/]*$", 1))
    assert sorted((r.path, r.line_no, r.raw) for r in got.collect()) == sorted(
        (f"{name}.txt", i + 1, f"{name}{i}") for name in ("a", "b") for i in range(80)
    )


def test_one_file_is_written_by_many_tasks(spark, tmp_path):
    """The parts of a file share its lines, so no task sorts all of them."""
    from fieldglass.plans import files as plan

    spark.range(4000).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "id % 7 AS user_id", "'x' AS event_type", "1.5D AS value", "'{}' AS props"
    ).write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    original = plan.new_folder

    def folder(session, label):
        seen.append(str(tmp_path / "lines"))
        return seen[-1]

    plan.new_folder = folder
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = plan.numbered_lines_split(spark, str(tmp_path))
        assert sorted(r.line_no for r in got.collect()) == list(range(1, 4001))
    finally:
        plan.new_folder = original
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    parts = list((tmp_path / "lines" / "file=0").glob("part-*"))
    assert len(parts) == 8 and max(p.stat().st_size for p in parts) < 0.3 * sum(p.stat().st_size for p in parts)


def test_decoding(spark):
    contents = [b"\xef\xbb\xbfa\xc3\xa9", "é".encode("utf-16"), b"\xfe\xff" + "é".encode("utf-16-be"), b"ok\xff"]
    df = spark.createDataFrame([(bytearray(c),) for c in contents], "c binary")
    assert [r[0] for r in df.select(lines.decoded_text(F.col("c"))).collect()] == ["aé", "é", "é", "ok�"]


@pytest.mark.parametrize(
    "physical, logical, label",
    [
        ("BYTE_ARRAY", {"Type": "String"}, "STRING"),
        ("INT32", None, "INT32"),
        (None, None, "GROUP"),
        ("INT32", {"Type": "Decimal", "precision": 10, "scale": 2}, "DECIMAL(10, 2)"),
        ("INT64", {"Type": "Timestamp", "isAdjustedToUTC": True, "timeUnit": "microseconds"}, "TIMESTAMP(MICROS, UTC)"),
        ("INT32", {"Type": "Int", "bitWidth": 16, "isSigned": True}, "INT16"),
        ("INT32", {"Type": "Int", "bitWidth": 32, "isSigned": False}, "UINT32"),
        ("BYTE_ARRAY", {"Type": "JSON"}, "JSON"),
        ("FIXED_LEN_BYTE_ARRAY", {"Type": "UUID"}, "UUID"),
    ],
)
def test_type_labels(physical, logical, label):
    assert columnar.type_label(physical, logical) == label


def test_archives(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("dir/", "")
        out.writestr("dir/a.txt", "hello")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as out:
        info = tarfile.TarInfo("b.txt")
        info.size = 3
        out.addfile(info, io.BytesIO(b"abc"))
    df = spark.createDataFrame(
        [("z", bytearray(z.getvalue())), ("t", bytearray(t.getvalue())), ("x", bytearray(b"PK\x03\x04broken"))],
        "archive string, content binary",
    )
    members = archives.list_members(df)
    got = sorted((r.archive, r.entry_path or "", r["size"], r.is_directory) for r in members.collect())
    assert got == [("t", "b.txt", 3, False), ("x", "", None, None), ("z", "dir/", 0, True), ("z", "dir/a.txt", 5, False)]
    totals = {r.archive: r for r in archives.archive_totals(members).collect()}
    assert (totals["z"].entries, totals["z"].expanded_bytes, totals["z"].problem) == (2, 5, None)
    assert totals["x"].problem == "end record missing"


ETHERNET = bytes.fromhex("02a4c6001f3d02b7e9520a68")


def ipv4(proto, payload, flags=0):
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 0, flags, 64, proto, 0, bytes([192, 168, 0, 10]), bytes([8, 8, 8, 8]))
    return head + payload


def udp(sport, dport, payload):
    return struct.pack(">4H", sport, dport, 8 + len(payload), 0) + payload


def tcp(sport, dport, payload, flags=0x18):
    return struct.pack(">2H2I2BH2H", sport, dport, 1, 2, 0x50, flags, 512, 0, 0) + payload


DNS = bytes.fromhex("123401000001000000000000") + b"\x07example\x03com\x00" + bytes.fromhex("00010001")


def hello(host):
    name = b"\x00" + struct.pack(">H", len(host)) + host
    extension = struct.pack(">2HH", 0, len(name) + 2, len(name)) + name
    body = b"\x03\x03" + bytes(32) + b"\x00" + b"\x00\x02\x13\x01" + b"\x01\x00" + struct.pack(">H", len(extension)) + extension
    handshake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(handshake)) + handshake


PACKETS = [
    (ETHERNET + b"\x08\x00" + ipv4(17, udp(40000, 53, DNS)), "DNS", "192.168.0.10:40000", "8.8.8.8:53", "example.com A"),
    (ETHERNET + b"\x08\x00" + ipv4(6, tcp(1, 443, hello(b"host.test"))), "TLS", "192.168.0.10:1", "8.8.8.8:443", "SNI host.test"),
    (ETHERNET + b"\x08\x00" + ipv4(6, tcp(5000, 80, b"GET /x HTTP/1.1\r\nHost: h\r\n\r\n")), "HTTP", "192.168.0.10:5000", "8.8.8.8:80", "GET /x HTTP/1.1 | Host: h"),
    (ETHERNET + b"\x08\x00" + ipv4(6, tcp(5000, 6000, b"hi")), "IPv4/TCP", "192.168.0.10:5000", "8.8.8.8:6000", "TCP PSH,ACK, seq=1, ack=2, win=512, 2 byte payload, payload 68 69 | hi"),
    (ETHERNET + b"\x08\x00" + ipv4(6, tcp(1, 1883, bytes.fromhex("30070003746f706869"))), "MQTT", "192.168.0.10:1", "8.8.8.8:1883", "PUBLISH, remaining=7, topic=top"),
    (ETHERNET + b"\x08\x00" + ipv4(17, udp(1, 5683, bytes.fromhex("44011234"))), "CoAP", "192.168.0.10:1", "8.8.8.8:5683", "v1, Confirmable, code=0.01, mid=4660, tokenLen=4"),
    (ETHERNET + b"\x08\x00" + ipv4(17, udp(123, 123, b"\x23\x02" + bytes(38) + b"\x00\x00\x00\x07" + bytes(4))), "NTP", "192.168.0.10:123", "8.8.8.8:123", "LI=0, version=4, mode=client, stratum=2, tx=7"),
    (ETHERNET + b"\x08\x00" + ipv4(1, b"\x08\x00"), "ICMP", "192.168.0.10", "8.8.8.8", "Type 8, code 0"),
    (ETHERNET + b"\x08\x00" + ipv4(99, b"abc", 0x2001), "IPv4/99", "192.168.0.10", "8.8.8.8", "fragment offset=8, more fragments;"),
    (ETHERNET + b"\x81\x00\x20\x05\x88\xa8\x00\x07\x12\x34zz", "Ethernet", "02:b7:e9:52:0a:68", "02:a4:c6:00:1f:3d", "EtherType 0x1234, 2 byte payload QinQ VLAN 5.1/7"),
    (ETHERNET + b"\x86\xdd" + bytes.fromhex("6000000000023aff") + bytes(15) + b"\x01" + bytes(15) + b"\x02" + b"\x80\x00", "ICMPv6", "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:2", "Type 128, code 0"),
    (b"", "-", "-", "-", "Empty packet"),
    (ETHERNET[:5], "Ethernet", "-", "-", "Truncated Ethernet frame"),
]


def dhcp(*options):
    fixed = bytes([1, 1, 6, 0]) + bytes.fromhex("0000abcd") + bytes(20) + bytes.fromhex("02b7e9520a68") + bytes(202) + bytes.fromhex("63825363")
    return fixed + b"".join(options) + b"\xff"


def test_packets(spark):
    record = lambda p: struct.pack("<4I", 1, 2, len(p), len(p)) + p
    head = bytes.fromhex("d4c3b2a1020004000000000000000000ffff000001000000")
    content = head + b"".join(record(p[0]) for p in PACKETS)
    df = spark.createDataFrame([("c", bytearray(content)), ("cut", bytearray(content[:-2])), ("bad", bytearray(b"nope" * 9))], "capture string, content binary")
    records = captures.pcap_records(df)
    rows = packets.dissect(records.where("capture = 'c'")).orderBy("n").collect()
    assert len(rows) == len(PACKETS)
    for row, (data, protocol, source, destination, info) in zip(rows, PACKETS, strict=True):
        assert (row.protocol, row.source, row.destination) == (protocol, source, destination), row
        assert info in row.info, row
        assert row.cap_len == len(data)
    assert [r.capture for r in captures.truncated_captures(df, records).orderBy("capture").collect()] == ["cut"]


@pytest.mark.parametrize("options, info", [([b"\x35\x01\x03"], "DHCP Request"), ([b"\x0c\x02hi", b"\x00", b"\x35\x01\x01"], "DHCP Discover"), ([], "Request")])
def test_dhcp(spark, options, info):
    p = ETHERNET + b"\x08\x00" + ipv4(17, udp(68, 67, dhcp(*options)))
    df = spark.createDataFrame([(bytearray(p), 1)], "packet binary, link_type int")
    row = packets.dissect(df).first()
    assert row.protocol == "DHCP" and row.info == f"{info}, xid=0x0000abcd, client=02:b7:e9:52:0a:68, ciaddr=0.0.0.0, yiaddr=0.0.0.0"


@pytest.mark.parametrize("order, magic", [("<", b"\x4d\x3c\x2b\x1a"), (">", b"\x1a\x2b\x3c\x4d")])
def test_pcapng(spark, order, magic):
    block = lambda kind, body: struct.pack(order + "2I", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))
    section = struct.pack(order + "2I", 0x0A0D0D0A, 28) + magic + struct.pack(order + "2Hq", 1, 0, -1) + struct.pack(order + "I", 28)
    raw = ipv4(1, b"\x08\x00")
    content = (
        section
        + block(1, struct.pack(order + "2HI", 1, 0, 0))
        + block(1, struct.pack(order + "2HI", 101, 0, 0))
        + block(6, struct.pack(order + "5I", 1, 0, 7, len(raw), len(raw)) + raw + bytes(-len(raw) % 4))
        + section
        + block(6, struct.pack(order + "5I", 3, 1, 0, 5, 5) + ETHERNET[:5] + bytes(3))
    )
    df = spark.createDataFrame([("g", bytearray(content))], "capture string, content binary")
    blocks = captures.pcapng_blocks(df)
    found = packets.dissect(packets.pcapng_packets(blocks)).orderBy("n").collect()
    assert [(r.protocol, r.link_type, r.ts_units, r.section) for r in found] == [("ICMP", 101, 7, 1), ("Ethernet", 1, 1 << 32, 2)]
    assert {r.kind: r.n for r in packets.block_counts(blocks).collect()} == {"Section Header": 2, "Interface Description": 2, "Enhanced Packet": 2}


def test_pcapng_walked_once(spark):
    """A packet before its interface still finds it, and no join is needed for that."""
    block = lambda kind, body: struct.pack("<2I", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    section = struct.pack("<2I", 0x0A0D0D0A, 28) + b"\x4d\x3c\x2b\x1a" + struct.pack("<2Hq", 1, 0, -1) + struct.pack("<I", 28)
    packet = lambda n: block(6, struct.pack("<5I", n, 0, 7, 20, 20) + ipv4(1, b""))
    content = section + packet(0) + packet(1) + block(1, struct.pack("<2HI", 101, 0, 0)) + section + packet(0)
    df = spark.createDataFrame([(f"g{i}", bytearray(content)) for i in range(3)], "capture string, content binary")
    found = packets.pcapng_packets(captures.pcapng_blocks(df))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan") == 1
    assert sorted((r.capture, r.n, r.link_type) for r in found.collect()) == [
        (f"g{i}", n, link) for i in range(3) for n, link in ((2, 101), (3, 1), (6, 1))
    ]


def test_small_captures_share_batches():
    import pyarrow as pa

    head = b"\xd4\xc3\xb2\xa1" + bytes(16) + struct.pack("<I", 1)
    content = head + b"".join(struct.pack("<4I", i, 0, 5, 5) + b"abcde" for i in range(3))
    given = pa.RecordBatch.from_pydict({"capture": [f"c{i}" for i in range(50)], "content": [content] * 50})
    made = list(captures._walker(captures._records, captures.RECORD_SCHEMA)(iter([given])))
    assert [b.num_rows for b in made] == [150]
    assert made[0].column("capture").to_pylist() == [f"c{i}" for i in range(50) for _ in range(3)]


def test_dissection_is_compiled(spark, capsys):
    """The JVM interprets methods of more than 8,000 bytes, so no generated method may be larger."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        packets.dissect(spark.createDataFrame([(bytearray(b"x"), 1)], "packet binary, link_type int")).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("make", [documents.pcap_docs, documents.pcapng_docs])
def test_records_are_written_before_they_are_gathered(spark, tmp_path, make):
    """The aggregate only gathers: what it works out itself is interpreted, not compiled."""
    spark.range(250).selectExpr("id AS event_id", "id % 7 AS user_id", "'view' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    docs = make(spark, str(tmp_path))
    plan = docs._jdf.queryExecution().executedPlan().toString().splitlines()
    gathered = [line for line in plan if "collect_list" in line]
    assert gathered and not any("hex(" in line for line in gathered)
    assert sorted(r.capture[1:] for r in docs.collect()) == ["0", "1", "2"]


def test_header_numbers_of_a_slice():
    """Numbers come from each value's own bytes, in slices and beside null and empty values too."""
    import numpy as np
    import pyarrow as pa

    frame = ETHERNET + b"\x81\x00\x00\x05\x08\x00" + ipv4(6, tcp(5, 6, b"hi"))
    values = pa.array([b"skipped", frame, None, b"", frame[:30], frame], pa.binary()).slice(1)
    found = headers.header_numbers(headers.Octets(values), np.array([1, 1, 1, 1, 0]))
    assert found["at"].tolist() == [18, 14, 14, 18, 0]
    assert found["dport"].tolist() == [6, -1, -1, -1, -1]
    assert found["body_at"].tolist() == [58, -1, -1, -1, -1] and found["body_size"].tolist() == [2, -1, -1, -1, -1]
    assert found["layer"].tolist() == [headers.IPV4, -1, -1, headers.IPV4, -1]
    assert headers.header_numbers(headers.Octets(values.slice(0, 0)), np.array([], int))["at"].size == 0


def test_stream(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write(source, "a.jsonl", '{"a":"Needle"}\nbroken\n\n')
    found = search_lines(with_line_kind(stream_lines(spark, str(source))), "needle")
    q = (
        found.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(target))
    )
    q.awaitTermination(60)
    assert [(r.raw, r.kind) for r in spark.read.parquet(str(target)).collect()] == [('{"a":"Needle"}', "valid")]


def test_parquet_window_over_files(spark, tmp_path):
    folder = str(tmp_path / "t.parquet")
    spark.range(100, 0, -1).select("id", (F.col("id") % 7).alias("m")).repartition(5).write.parquet(folder)
    files = sorted(str(p) for p in (tmp_path / "t.parquet").glob("part-*"))
    import pyarrow.parquet as pq

    stored = [r for f in files for r in pq.read_table(f)["id"].to_pylist()]
    for start, size in ((0, 5), (13, 50), (95, 40), (0, 1000), (200, 3), (7, 0)):
        got = columnar.read_parquet_window(spark, folder, ["id"], start, size)
        assert sorted((r.pos, r.id) for r in got.collect()) == list(enumerate(stored))[start : start + size]
    one = columnar.read_parquet_window(spark, folder, ["m"], 13, 2)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder_of_tables(spark, tmp_path):
    """A table stored as one file, and one stored as a folder of three parts."""
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "made"))
    (part,) = (tmp_path / "made").glob("*.parquet")
    root = tmp_path / "tables"
    root.mkdir()
    part.rename(root / "orders.parquet")
    spark.range(0, 40, 1, 3).write.parquet(str(root / "region.parquet"))
    return str(root)


def test_inventory_of_tables_in_parts(spark, folder_of_tables):
    for root in (folder_of_tables, f"file:{folder_of_tables}/"):
        found = files.file_inventory(spark, root).orderBy("name").collect()
        assert [tuple(r) for r in found] == [(n, ".parquet", True, "parquet") for n in ("orders.parquet", "region.parquet")]


def test_signatures_of_tables_in_parts(spark, folder_of_tables):
    found = files.file_signature(spark, folder_of_tables).orderBy("name").collect()
    assert [tuple(r) for r in found] == [(n, "parquet", "Parquet magic at both ends", True) for n in ("orders.parquet", "region.parquet")]


def write_sparse(path, size, head, tail=b""):
    """A file whose middle takes no room on the disk."""
    with open(path, "wb") as handle:
        handle.write(head)
        handle.seek(size - len(tail))
        handle.write(tail)
        handle.truncate(size)


def test_signatures_of_files_that_no_task_could_hold(spark, tmp_path):
    size = 3 << 30
    write_sparse(tmp_path / "orders.parquet", size, b"PAR1", b"PAR1")
    write_sparse(tmp_path / "region.parquet", size, b"PAR1")
    found = files.file_signature(spark, str(tmp_path)).orderBy("name").collect()
    assert [tuple(r) for r in found] == [
        ("orders.parquet", "parquet", "Parquet magic at both ends", True),
        ("region.parquet", "parquet", "extension", False),
    ]
    write_sparse(tmp_path / "picture", size, bytes.fromhex("89504E470D0A1A0A"))
    write_sparse(tmp_path / "table.csv", size, b"a,b\n1,2\n")
    write_sparse(tmp_path / "noise", size, b"a,b\n")
    found = classify.classify_stored(spark, str(tmp_path), name=F.regexp_extract("path", "[^/]*$", 0))
    assert {(r.name, r.kind, r.size) for r in found.where("name NOT LIKE '%.parquet'").collect()} == {
        ("picture", "image", size), ("table.csv", "csv", size), ("noise", "unknown", size),
    }


@pytest.fixture
def odd_files(tmp_path):
    long = b'{"traceEvents":[' + b"0," * 60000 + b"0]}"
    rows = "".join(f"{i};{i * 3}\n" for i in range(20000)).encode()
    made = {
        "a b%20+.json": b'{"version":"2.1.0","runs":[]}', "#ü?.svg": b"\xef\xbb\xbf<svg/>", "long": long, "long.json": long, "long.csv": long,
        "rows": rows, "cut": long[:-1], "ab": b"ab", "late.xml": b" " * 70000 + b"<mxfile/>",
        "m.tar": bytes(257) + b"ustar" + bytes(70000), "zip": b"PK\x03\x04" + bytes(40000) + b"word/document.xml",
        "far.zip": b"PK\x03\x04" + bytes(70000) + b"word/document.xml", "noise": bytes([1, 2, 3]), "pdf.json": b"%PDF-1.7",
        "sub/page": b"<html><body>", "PAR1.parquet": b"PAR1" + bytes(8) + b"PAR1", "PAR.parquet": b"PAR1PAR1",
    }
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path), len(made)


def test_stored_files_are_what_their_whole_contents_are(spark, odd_files):
    root, n = odd_files
    columns = ["path", "name", "size", "kind", "reason", "by_signature", "ext_kind"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    whole = rows(classify.classify_files(contents.read_files(spark, root)))
    found = classify.classify_stored(spark, root)
    assert rows(found) == whole and len(whole) == n
    assert {r.name: r.kind for r in found.collect()}.items() >= {
        "long": "trace", "long.json": "trace", "long.csv": "csv", "rows": "csv", "cut": "csv", "late.xml": "drawio", "far.zip": "archive",
    }.items()


def test_stored_files_where_only_spark_reads(spark, odd_files):
    root, n = odd_files
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{root}")
    remote = "viewfs://store/in"
    assert contents.opens_in_parts(contents.read_files(spark, root))
    assert not contents.opens_in_parts(contents.read_files(spark, remote))
    kinds = lambda path: sorted(map(str, classify.classify_stored(spark, path).select("name", "kind", "reason").collect()))
    assert kinds(remote) == kinds(root) and len(kinds(root)) == n


def test_footers_of_tables_in_parts(spark, folder_of_tables):
    found = files.parquet_footer_profile(spark, folder_of_tables).orderBy("name").collect()
    assert [tuple(r) for r in found] == [("orders.parquet", 5, True), ("region.parquet", 40, True)]
    types = files.parquet_column_types(spark, folder_of_tables).orderBy("name").collect()
    assert [tuple(r) for r in types] == [(n, 0, "id", "INT64") for n in ("orders.parquet", "region.parquet")]


def test_archives_of_a_batch_are_listed_in_slices():
    import pyarrow as pa

    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w") as z:
        for i in range(100):
            z.writestr(f"{i}.txt", "x" * 5000)
    data = stream.getvalue()
    batch = pa.RecordBatch.from_pydict({"archive": [str(i) for i in range(20)], "content": [data] * 20})
    listed = list(archives._list(iter([batch])))
    assert len(listed) >= 9 and sum(b.num_rows for b in listed) == 2000
    assert {b.column(0)[i].as_py() for b in listed for i in range(b.num_rows)} == {str(i) for i in range(20)}
