"""What a file or a text is: ordered first-match rules compiled to CASE.

A rule is ``(kind, reason, condition)``. The first rule that holds decides, so
a whole rule table is one CASE expression over a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions.binding import let
from fieldglass.functions.cells import WHITESPACE
from fieldglass.functions.formatting import extension_of, looks_like_text, utf8_text
from fieldglass.functions.json_text import json_kind, strict_json
from fieldglass.functions.octets import digits, i32le, u8, u16be, u16le, u32be, u32le
from fieldglass.sources.contents import fill_contents, opens_in_parts, read_files, with_ends
from fieldglass.sources.delimited import sniff_delimiter

HEAD_BYTES = 64 * 1024

# File kind per extension.
EXTENSION_KINDS = {
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".svg"],
    "pdf": [".pdf"],
    "csv": [".csv", ".tsv"],
    "json": [".json"],
    "jsonl": [".jsonl", ".ndjson", ".jsonlines"],
    "har": [".har"],
    "yaml": [".yaml", ".yml"],
    "toml": [".toml"],
    "xml": [
        ".xml", ".xsd", ".xsl", ".xslt", ".wsdl", ".xlf", ".xliff", ".rss", ".atom", ".xaml", ".resx",
        ".csproj", ".vcxproj", ".nuspec",
    ],
    "notebook": [".ipynb"],
    "epub": [".epub"],
    "font": [".ttf", ".otf", ".woff"],
    "arrow": [".arrow", ".feather"],
    "geojson": [".geojson"],
    "text": [".txt"],
    "dicom": [".dcm", ".dicom"],
    "eml": [".eml"],
    "mcap": [".mcap"],
    "mesh": [".glb", ".gltf", ".stl", ".obj"],
    "sarif": [".sarif", ".sarif.json"],
    "gps": [".gpx", ".kml", ".kmz"],
    "trace": [".trace.json", ".chrome-trace"],
    "sbom": [".cdx.json", ".cyclonedx.json"],
    "msg": [".msg"],
    "drawio": [".drawio", ".dio"],
    "opendocument": [".odt", ".odp"],
    "html": [".html", ".htm"],
    "markdown": [".md", ".markdown"],
    "latex": [".tex", ".latex", ".ltx"],
    "mermaid": [".mmd", ".mermaid"],
    "plantuml": [".puml", ".plantuml", ".iuml"],
    "proto": [".proto"],
    "shapefile": [".shp"],
    "automotive": [".dbc", ".arxml", ".a2l", ".asc", ".blf", ".mf4", ".mdf"],
    "avro": [".avro"],
    "bag": [".bag"],
    "stp": [".stp", ".step"],
    "db3": [".db3", ".sqlite", ".sqlite3"],
    "reqif": [".reqif"],
    "pcap": [".pcap"],
    "pcapng": [".pcapng"],
    "mat": [".mat"],
    "hdf5": [".h5", ".hdf5"],
    "numpy": [".npy", ".npz"],
    "gguf": [".gguf"],
    "onnx": [".onnx"],
    "tflite": [".tflite", ".lite"],
    "pte": [".pte"],
    "pt2": [".pt2"],
    "keras": [".keras"],
    "coreml": [".mlmodel", ".mlpackage"],
    "safetensors": [".safetensors"],
    "audio": [".mp3", ".wav", ".ogg", ".flac", ".aac", ".m4a", ".pcm"],
    "video": [".mp4", ".webm", ".mov", ".m4v", ".ogv"],
    "excel": [".xlsx", ".xls"],
    "word": [".docx", ".doc"],
    "ppt": [".pptx", ".ppt"],
    "psd": [".psd"],
    "parquet": [".parquet"],
    "hwp": [".hwp", ".hwpx"],
    "archive": [".zip", ".jar", ".apk", ".tar", ".tgz", ".gz", ".7z", ".rar"],
}

# Media type per extension, as the members of archives use it.
IMAGE_TYPES = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif",
    ".webp": "image/webp", ".bmp": "image/bmp", ".svg": "image/svg+xml",
}
AUDIO_TYPES = {
    ".wav": "audio/wav", ".mp3": "audio/mpeg", ".flac": "audio/flac", ".ogg": "audio/ogg",
    ".oga": "audio/ogg", ".m4a": "audio/mp4",
}
VIDEO_TYPES = {
    ".mp4": "video/mp4", ".m4v": "video/mp4", ".webm": "video/webm", ".mov": "video/quicktime", ".ogv": "video/ogg",
}
# Archive format per extension, two-part ones first.
ARCHIVE_EXTENSIONS = {
    ".tar.gz": "tarGz", ".tar.bz2": "tarBz2", ".tar.xz": "tarXz",
    ".zip": "zip", ".jar": "jar", ".apk": "apk", ".rar": "rar", ".7z": "sevenZip", ".tar": "tar",
    ".tgz": "tarGz", ".tbz2": "tarBz2", ".txz": "tarXz", ".gz": "gz", ".bz2": "bz2", ".xz": "xz", ".dmg": "dmg",
}
# Archive format per leading bytes (hex), in order.
ARCHIVE_MAGIC = (
    ("bz2", 0, "425A68"),
    ("xz", 0, "FD377A585A00"),
    ("gz", 0, "1F8B"),
    ("sevenZip", 0, "377ABCAF271C"),
    ("zip", 0, "504B0304"),
    ("rar", 0, "526172211A0700"),
    ("rar", 0, "526172211A070100"),
    ("tar", 257, "7573746172"),
)

TEXT_PREVIEW_BYTES = 256 * 1024


def first_match(rules: list[tuple[str, str, Column]]) -> Column:
    """``struct(kind, reason)`` of the first rule that holds, null when none does."""
    verdict = lambda k, r: F.struct(F.lit(k).alias("kind"), F.lit(r).alias("reason"))
    first = F.when(rules[0][2], verdict(*rules[0][:2]))
    return reduce(lambda case, rule: case.when(rule[2], verdict(*rule[:2])), rules[1:], first)


def _ascii(text: str) -> str:
    return text.encode("latin-1").hex().upper()


def extension_registry(spark: SparkSession) -> DataFrame:
    """``(ext, kind)`` for every known extension; a table of fixed size."""
    rows = [(ext, kind) for kind, exts in EXTENSION_KINDS.items() for ext in exts]
    return spark.createDataFrame(rows, "ext string, kind string")


def with_extension_kind(df: DataFrame, name: Column) -> DataFrame:
    """Add ``ext_kind``: the two-part extension is looked up before the last part."""
    registry = F.broadcast(extension_registry(df.sparkSession))
    low = F.lower(name)
    two = registry.select(F.col("ext").alias("_two"), F.col("kind").alias("_two_kind"))
    one = registry.select(F.col("ext").alias("_one"), F.col("kind").alias("_one_kind"))
    keyed = df.withColumn("_two", F.regexp_extract(low, r"(\.[^.]*\.[^.]*)$", 1)).withColumn(
        "_one", F.regexp_extract(low, r"(\.[^.]*)$", 1)
    )
    return (
        keyed.join(two, "_two", "left")
        .join(one, "_one", "left")
        .withColumn("ext_kind", F.coalesce("_two_kind", "_one_kind"))
        .drop("_one", "_two", "_one_kind", "_two_kind")
    )


def archive_format(name: Column, head: Column | None = None) -> Column:
    """Archive format: leading bytes win over the name, two-part names over one."""
    low = F.lower(name)
    by_name = reduce(
        lambda case, item: case.when(low.endswith(item[0]), item[1]),
        ARCHIVE_EXTENSIONS.items(),
        F.when(F.lit(False), None),
    )
    if head is None:
        return by_name
    return F.coalesce(archive_magic(head), by_name)


def archive_magic(head: Column) -> Column:
    return let(F.hex(F.substring(head, 1, 300)), archive_magic_of)


def archive_magic_of(hexed: Column) -> Column:
    return reduce(
        lambda case, rule: case.when(digits(hexed, rule[1], len(rule[2]) // 2) == rule[2], rule[0]),
        ARCHIVE_MAGIC,
        F.when(F.lit(False), None),
    )


# Fixed values of the Arrow columnar format: the header type of a schema, the newest metadata version.
ARROW_SCHEMA, ARROW_VERSION = 1, 4


def _flatbuffer_field(h: Column, table: Column, slot: int) -> Column:
    """Where a field of a FlatBuffers table lies; null where the table does not hold it.

    A table begins with the distance back to its list of field offsets; that list begins
    with its own size and the table's.
    """

    def place(listed: Column) -> Column:
        offset = F.when(u16le(h, listed) >= 6 + 2 * slot, u16le(h, listed + 4 + 2 * slot))
        return F.when(offset > 0, table + offset)

    return let(F.when(i32le(h, table) <= table, table - i32le(h, table)), place)


def _arrow_message(h: Column, size: Column) -> Column:
    """An encapsulated message with a schema, which opens an Arrow stream.

    Metadata follow their length, padded so that they end on a multiple of eight bytes;
    newer writers put a continuation mark in front.
    """

    def schema_from(start: Column) -> Column:
        metadata = u32le(h, start - 4)
        framed = (metadata > 0) & ((start + metadata) % 8 == 0) & (start + metadata <= size)
        told = lambda message: (u8(h, _flatbuffer_field(h, message, 1)) == ARROW_SCHEMA) & F.coalesce(
            u16le(h, _flatbuffer_field(h, message, 0)) <= ARROW_VERSION, F.lit(True)
        )
        return framed & let(start + u32le(h, start), told)

    return F.coalesce(let(F.when(h.startswith("FFFFFFFF"), 8).otherwise(4), schema_from), F.lit(False))


def _font_tables(h: Column, header: int, record: int, count: Column, sound) -> Column:
    """Whether the records behind a font's header are in order of their tags and ``sound``.

    Tags are four printable characters in ascending order, none twice; as many records
    are read as the head of the file holds.
    """
    area = F.substring(h, F.lit(header * 2 + 1), (count * record * 2).cast("int"))
    records = F.regexp_extract_all(area, F.lit("[0-9A-F]{%d}" % (record * 2)), F.lit(0))

    def checked(rows: Column) -> Column:
        tags = F.transform(rows, lambda r: F.substring(r, 1, 8))
        ordered = tags == F.array_sort(F.array_distinct(tags))
        readable = F.forall(tags, lambda t: t.rlike("^([2-6][0-9A-F]|7[0-9A-E]){4}$"))
        return (F.size(rows) > 0) & ordered & readable & F.forall(rows, sound)

    return let(records, checked)


def _sfnt_font(h: Column, size: Column) -> Column:
    """A TrueType or OpenType font: each table ends inside the file."""
    inside = lambda r: u32be(r, 8) + u32be(r, 12) <= size
    return F.coalesce(_font_tables(h, 12, 16, u16be(h, 4), inside), F.lit(False))


def _woff_font(h: Column, size: Column) -> Column:
    """A WOFF font: it knows its length, and no stored table is longer than the table itself."""
    sound = lambda r: (u32be(r, 4) + u32be(r, 8) <= size) & (u32be(r, 8) <= u32be(r, 12))
    header = (u32be(h, 8) == size) & (u16be(h, 14) == 0) & (u32be(h, 16) % 4 == 0)
    return F.coalesce(header & _font_tables(h, 44, 20, u16be(h, 12), sound), F.lit(False))


def signature(name: Column, head: Column, tail: Column, size: Column) -> Column:
    """``struct(kind, reason)`` by leading bytes, null when no rule holds.

    What the rules look at is computed once per file and bound; the rules are
    then evaluated one after the other until one holds.
    """
    view = F.struct(
        extension_of(name).alias("ext"),
        F.hex(F.substring(head, 1, 4096)).alias("h"),
        F.decode(head, "ISO-8859-1").alias("latin"),
        F.hex(tail).alias("tail"),
        size.alias("size"),
    )
    return let(view, lambda v: first_match(signature_rules(v["ext"], v["h"], v["latin"], v["tail"], v["size"])))


def signature_rules(
    ext: Column, h: Column, latin: Column, tail: Column, size: Column
) -> list[tuple[str, str, Column]]:
    """Rules on leading bytes, in the order in which they decide."""
    at = lambda offset, hexes: digits(h, offset, len(hexes) // 2) == hexes.upper()
    word = lambda text, offset=0: at(offset, _ascii(text))
    byte0, byte1 = u8(h, 0), u8(h, 1)
    markup_name = ext.isin(*EXTENSION_KINDS["xml"], ".html", ".htm", ".geojson", ".txt", ".eml", ".sarif", ".drawio")
    is_zip, is_ole = at(0, "504B0304"), at(0, "D0CF11E0A1B11AE1")
    office = {
        "word": [".doc", ".docx"], "excel": [".xls", ".xlsx"], "ppt": [".ppt", ".pptx"], "hwp": [".hwp", ".hwpx"],
    }
    member = lambda part: F.contains(latin, F.lit(part))
    first_tag = F.ltrim(F.regexp_replace(F.substring(latin, 1, 2048), "^\xef\xbb\xbf", ""), F.lit(WHITESPACE))
    rules = [
        ("dicom", "DICOM marker", word("DICM", 128)),
        ("mcap", "MCAP magic", at(0, "894D434150300D0A")),
        (
            "mesh", "GLB header",
            word("glTF") & (u32le(h, 4) == 2) & (u32le(h, 8) == size) & word("JSON", 16)
            & (u32le(h, 12) >= 4) & (u32le(h, 12) % 4 == 0) & (u32le(h, 12) + 20 <= size),
        ),
        ("arrow", "Arrow file", word("ARROW1")),
        ("arrow", "Arrow schema message", _arrow_message(h, size)),
        ("font", "TrueType header", at(0, "00010000")),
        ("font", "font directory", (word("true") | word("OTTO")) & _sfnt_font(h, size)),
        ("font", "WOFF directory", word("wOFF") & _woff_font(h, size)),
        ("pdf", "PDF header", word("%PDF-")),
        ("psd", "PSD signature", word("8BPS")),
        ("image", "PNG signature", at(0, "89504E470D0A1A0A")),
        ("image", "JPEG signature", at(0, "FFD8FF")),
        ("image", "GIF signature", word("GIF87a") | word("GIF89a")),
        ("image", "BMP signature", word("BM")),
        ("image", "WebP signature", word("RIFF") & word("WEBP", 8)),
        (
            "image", "SVG markup",
            (ext == ".svg") & (first_tag.startswith("<svg") | (first_tag.startswith("<?xml") & F.contains(first_tag, F.lit("<svg")))),
        ),
        ("audio", "FLAC signature", word("fLaC")),
        ("audio", "OGG signature", word("OggS")),
        ("audio", "ID3 tag", word("ID3")),
        ("audio", "MP3 frame", ~markup_name & (byte0 == 255) & (byte1 >= 0xE0)),
        ("audio", "WAV signature", word("RIFF") & word("WAVE", 8)),
        ("audio", "AIFF container", word("FORM") & (word("AIFF", 8) | word("AIFC", 8))),
        ("audio", "AC-3 sync word", at(0, "0B77")),
        ("audio", "AMR header", word("#!AMR\n") | word("#!AMR-WB\n")),
        ("video", "AVI signature", word("RIFF") & word("AVI ", 8)),
        ("audio", "MP4 family, audio name", word("ftyp", 4) & (size >= 12) & (ext == ".m4a")),
        ("video", "MP4 family", word("ftyp", 4) & (size >= 12)),
        ("video", "Matroska container", at(0, "1A45DFA3") & ext.isin(".webm", ".mkv")),
        ("video", "transport stream", (byte0 == 0x47) & (u8(h, 188) == 0x47) & (u8(h, 376) == 0x47) & (size >= 564)),
        ("video", "FLV container", at(0, "464C5601")),
        ("video", "ASF container", at(0, "3026B2758E66CF11A6D900AA0062CE6C")),
        ("parquet", "Parquet magic at both ends", word("PAR1") & (tail == _ascii("PAR1")) & (size >= 12)),
        ("keras", "HDF5 signature, Keras name", at(0, "894844460D0A1A0A") & (ext == ".keras")),
        ("hdf5", "HDF5 signature", at(0, "894844460D0A1A0A")),
        ("numpy", "NumPy magic", at(0, "934E554D5059")),
        ("gguf", "GGUF magic", word("GGUF")),
        ("tflite", "TFLite identifier", word("TFL3", 4)),
        ("pte", "ExecuTorch identifier", word("ET12", 4)),
        (
            "safetensors", "safetensors header",
            (u32le(h, 4) == 0) & (u32le(h, 0) > 0) & (u32le(h, 0) + 8 <= size) & word("{", 8)
            & F.substring(latin, 9, 4096).rlike(r'^\{\s*("|\})'),
        ),
        ("automotive", "BLF signature", word("LOGG")),
        ("automotive", "MDF signature", word("MDF ") | word("UnFinMF ")),
        ("avro", "Avro container", at(0, "4F626A01")),
        ("bag", "ROS bag header", word("#ROSBAG V2.")),
        ("db3", "SQLite header", word("SQLite format 3\x00")),
        ("pcap", "PCAP header", F.substring(h, 1, 8).isin("D4C3B2A1", "A1B2C3D4", "4D3CB2A1", "A1B23C4D")),
        ("pcapng", "PCAPNG section header", at(0, "0A0D0D0A")),
        ("shapefile", "shapefile header", (u32be(h, 0) == 9994) & (u32le(h, 28) == 1000) & (ext != ".shx")),
        ("msg", "compound file, message name", is_ole & (ext == ".msg")),
    ]
    rules += [(k, "compound file, Office name", is_ole & ext.isin(v)) for k, v in office.items()]
    rules += [
        ("word", "compound file, Word stream", is_ole & member("WordDocument")),
        ("excel", "compound file, workbook stream", is_ole & member("Workbook")),
        ("ppt", "compound file, slides stream", is_ole & member("PowerPoint Document")),
        ("hwp", "compound file, HWP stream", is_ole & (member("FileHeader") | member("HwpSummaryInformation"))),
        ("numpy", "ZIP, NumPy name", is_zip & (ext == ".npz")),
        ("epub", "ZIP, book", is_zip & ((ext == ".epub") | member("mimetypeapplication/epub+zip"))),
        ("keras", "ZIP, Keras name", is_zip & (ext == ".keras")),
        ("coreml", "ZIP, Core ML name", is_zip & (ext == ".mlpackage")),
        ("pt2", "ZIP, exported program name", is_zip & (ext == ".pt2")),
        ("gps", "ZIP, map name", is_zip & (ext == ".kmz")),
        ("opendocument", "ZIP, OpenDocument", is_zip & (ext.isin(".odt", ".odp") | member("application/vnd.oasis.opendocument."))),
    ]
    rules += [(k, "ZIP, Office name", is_zip & ext.isin(v)) for k, v in office.items()]
    rules += [
        ("word", "ZIP, Word members", is_zip & member("word/")),
        ("excel", "ZIP, Excel members", is_zip & member("xl/")),
        ("ppt", "ZIP, PowerPoint members", is_zip & member("ppt/")),
        ("hwp", "ZIP, HWPX members", is_zip & (member("Contents/content.hpf") | member("Contents/section") | member("version.xml"))),
        ("keras", "ZIP, Keras members", is_zip & member("config.json") & member("model.weights.h5")),
        ("pt2", "ZIP, exported program members", is_zip & (member("archive_format") | member("serialized_exported_program.json"))),
        ("coreml", "ZIP, Core ML members", is_zip & member("Manifest.json") & member("Data/com.apple.CoreML/")),
        ("archive", "ZIP signature", is_zip),
        ("archive", "archive signature", archive_magic_of(h).isNotNull()),
    ]
    return rules


# Kinds by extension that the text may narrow down.
DIALECT_NAMES = ("json", "xml")


def classify_files(files: DataFrame) -> DataFrame:
    """``kind``, ``reason``, ``by_signature`` and ``ext_kind`` in place of the content.

    Leading bytes decide first, then the extension, then the text. Signatures
    look at the first 64 KiB; texts are read whole. The only join is with the
    small extension table, so contents are dropped in the task that read them.
    """
    content, size = F.col("content"), F.col("size")
    found = signature(F.col("name"), F.substring(content, 1, HEAD_BYTES), F.substring(content, -4, 4), size)
    return _verdict(with_extension_kind(files, F.col("name")).withColumn("_found", F.when(size > 0, found)))


def classify_stored(
    spark: SparkSession, path: str | list[str], pattern: str = "*", name: Column | None = None
) -> DataFrame:
    """``classify_files`` of the files in a folder, whose ``name`` may be derived from their ``path``.

    Of a file that its ends or its name decide, only the ends are read, so its size costs nothing and has no
    limit. A file that its text decides is read whole in the same task. In a store that Arrow cannot open, Spark
    reads all files whole.
    """
    files = read_files(spark, path, pattern)
    if name is not None:
        files = files.withColumn("name", name)
    if not opens_in_parts(files):
        return classify_files(files)
    head, size, ext = F.col("head"), F.col("size"), F.col("ext_kind")
    ended = with_extension_kind(with_ends(files.drop("content"), HEAD_BYTES), F.col("name"))
    found = ended.withColumn("_found", F.when(size > 0, signature(F.col("name"), head, F.col("tail"), size)))
    by_text = F.col("_found").isNull() & (ext.isin(*DIALECT_NAMES) | (ext.isNull() & looks_like_text(head)))
    asked = found.withColumn("_by_text", F.coalesce(by_text, F.lit(False)))
    held = asked.withColumn("content", F.when(F.col("_by_text") & (size <= HEAD_BYTES), head))
    unread = held.withColumn("unread", F.col("_by_text") & (size > HEAD_BYTES))
    return _verdict(fill_contents(unread.drop("head", "tail", "_by_text")))


def _verdict(files: DataFrame) -> DataFrame:
    """The kind by ``_found``, else by the name and the content."""
    content, size = F.col("content"), F.col("size")
    text = F.when(looks_like_text(content), text_kind(utf8_text(content)))
    dialect = F.when(F.col("ext_kind").isin(*DIALECT_NAMES), document_dialect(utf8_text(content)))
    return (
        files.withColumn("kind", F.coalesce(F.col("_found.kind"), dialect, F.col("ext_kind"), text, F.lit("unknown")))
        .withColumn(
            "reason",
            F.coalesce(
                F.col("_found.reason"),
                F.when(size == 0, "empty file"),
                F.when(F.col("ext_kind").isNotNull(), "extension"),
                F.lit("text content"),
            ),
        )
        .withColumn("by_signature", F.col("_found").isNotNull())
        .drop("_found", "content")
    )


# ---------------------------------------------------------------- text kinds

# First words of diagram texts.
MERMAID_WORDS = [
    "graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram(?:-v2)?", "erDiagram", "gantt",
    "journey", "gitGraph", "pie", "quadrantChart", "requirementDiagram", "mindmap", "timeline", "zenuml",
    "sankey-beta", "block-beta", "architecture-beta", "packet-beta", "xychart-beta",
]

# Fixed patterns of the text kinds.
HTML_START = r"(?is)^\x{FEFF}?\s*(?:<!--.*?-->\s*)*+(<!doctype\s+html[\s>\[]|<html[\s>])"
XML_START = (
    r"(?s)^\x{FEFF}?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE(?:[^\[>]*\[.*?\]\s*>|[^\[>]*>)\s*)*+"
    r"<([A-Za-z_:\x{C0}-\x{FFFF}][\w.:\-\x{B7}\x{C0}-\x{FFFF}]*)[\s/>]"
)
TOML_TABLE = r"""^\[\[?[A-Za-z0-9_.\-"'\s]+\]?\]$"""
TOML_PAIR = r"""^[A-Za-z0-9_.\-"']+\s*="""
LATEX_CLASS = r"^\\documentclass\s*(\[|\{)"
MERMAID = "^(" + "|".join(MERMAID_WORDS) + r")\b"
PLANTUML_START = r"(?i)^@start(?:uml|plantuml|mindmap|wbs|gantt|json|yaml|salt|ditaa)?\b"
PLANTUML_LINES = (
    r"(?i)^(actor|participant|boundary|control|entity|database|collections|queue)\s+",
    r"(?i)^(abstract\s+class|class|interface|enum|annotation)\s+",
    r"(?i)^(:.+;|start|stop|if\s*\(.+\)\s*then\b)",
)


def text_lines(text: Column) -> Column:
    """Trimmed, non-empty lines."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda s: F.btrim(s, F.lit(WHITESPACE)))
    return F.filter(lines, lambda s: s != "")


def is_container(value: Column) -> Column:
    return F.coalesce(json_kind(value).isin("object", "array"), F.lit(False))


def looks_like_html(text: Column) -> Column:
    return text.rlike(HTML_START)


def looks_like_xml(text: Column) -> Column:
    root = F.lower(F.regexp_extract(text, XML_START, 1))
    return text.rlike(r"^\x{FEFF}?\s*<") & ~looks_like_html(text) & ~root.isin("", "html")


def looks_like_toml(lines: Column) -> Column:
    top = F.slice(lines, 1, 20)
    tables = F.size(F.filter(top, lambda s: s.rlike(TOML_TABLE)))
    pairs = F.size(F.filter(top, lambda s: ~s.rlike(TOML_TABLE) & s.rlike(TOML_PAIR)))
    return ((tables > 0) & (pairs > 0)) | (pairs >= 3)


def looks_like_plantuml(lines: Column) -> Column:
    top = F.slice(lines, 1, 30)
    return F.exists(top, lambda s: reduce(lambda a, p: a | s.rlike(p), PLANTUML_LINES, s.rlike(PLANTUML_START)))


def looks_like_mermaid(lines: Column) -> Column:
    code = F.get(F.filter(lines, lambda s: ~s.startswith("%%")), F.lit(0))
    return F.coalesce(code.rlike(MERMAID), F.lit(False))


def _own(value: Column, path: str, dtype: str) -> Column:
    return F.try_variant_get(value, path, dtype).isNotNull()


def json_dialect_of(value: Column) -> Column:
    """Dialect of a parsed JSON document by its own members, else ``json``."""
    kind = F.try_variant_get(value, "$.type", "string")
    has = lambda key: F.array_contains(F.map_keys(value.try_cast("map<string,variant>")), key)
    geometry = kind.isin("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
    return (
        F.when(_own(value, "$.log.entries", "array<variant>"), "har")
        .when((F.try_variant_get(value, "$.nbformat", "bigint") == 4) & _own(value, "$.cells", "array<variant>"), "notebook")
        .when(_own(value, "$.runs", "array<variant>") & _own(value, "$.version", "string"), "sarif")
        .when(F.try_variant_get(value, "$.bomFormat", "string") == "CycloneDX", "sbom")
        .when(_own(value, "$.traceEvents", "array<variant>"), "trace")
        .when((kind == "FeatureCollection") & _own(value, "$.features", "array<variant>"), "geojson")
        .when((kind == "Feature") & has("geometry") & has("properties"), "geojson")
        .when((kind == "GeometryCollection") & _own(value, "$.geometries", "array<variant>"), "geojson")
        .when(geometry & _own(value, "$.coordinates", "array<variant>"), "geojson")
        .when(is_container(value), "json")
    )


# A document without one of these keys, or an escape that could spell one,
# belongs to no dialect.
DIALECT_KEYS = r'"(log|nbformat|runs|bomFormat|traceEvents|type)"|\\u'


def json_dialect(text: Column) -> Column:
    """Dialect of a JSON document, ``json`` for any other one, null for non-JSON and scalars."""

    def of_body(body: Column) -> Column:
        special = F.when(body.rlike(DIALECT_KEYS), let(strict_json(body), json_dialect_of))
        plain = F.when(strict_json(body).isNotNull(), "json")
        return F.when(body.rlike(r"^[\{\[]"), F.coalesce(special, plain))

    return let(F.btrim(text, F.lit(WHITESPACE)), of_body)


# Root elements and namespaces of the map dialects.
GPX_SPACES = ("", "http://www.topografix.com/GPX/1/0", "http://www.topografix.com/GPX/1/1")
KML_SPACES = (
    "", "http://www.opengis.net/kml/2.2", "http://earth.google.com/kml/2.0",
    "http://earth.google.com/kml/2.1", "http://earth.google.com/kml/2.2",
)


# A name of an XML element or prefix.
XML_NAME = r"[\p{L}_][\p{L}\p{M}\p{N}_.\-\x{B7}]*"


def xml_root(text: Column) -> Column:
    """``struct(prefix, name, space)`` of the root element."""
    prologue = r"(?s)^\x{FEFF}?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE(?:[^\[>]*\[.*?\]\s*>|[^\[>]*>)\s*)*+"
    tag = F.regexp_extract(text, prologue + r"(<[^>]*>?)", 1)
    prefix = F.regexp_extract(tag, rf"^<({XML_NAME}):", 1)
    name = F.regexp_extract(tag, rf"^<(?:{XML_NAME}:)?({XML_NAME})(?=[\s/>]|$)", 1)
    names = F.regexp_extract_all(tag, F.lit(rf"""\sxmlns(?::({XML_NAME}))?\s*=\s*(?:"[^"]*"|'[^']*')"""), 1)
    spaces = F.regexp_extract_all(tag, F.lit(rf"""\sxmlns(?::{XML_NAME})?\s*=\s*["']([^"']*)["']"""), 1)
    spot = F.array_position(names, prefix)
    space = F.when(spot > 0, F.get(spaces, (spot - 1).cast("int"))).otherwise("")
    return F.struct(prefix.alias("prefix"), name.alias("name"), space.alias("space"))


def xml_dialect(text: Column) -> Column:
    """gps, junit, drawio, openvino or xml by the root element; null without one."""
    return let(xml_root(text), lambda root: _xml_dialect(text, root))


def _xml_dialect(text: Column, root: Column) -> Column:
    gps = ((root["name"] == "gpx") & root["space"].isin(*GPX_SPACES)) | (
        (root["name"] == "kml") & root["space"].isin(*KML_SPACES)
    )
    net = text.rlike(r"""(?s)<net\s[^>]*\bversion\s*=\s*["']\d+["'][^>]*>.*<layers[\s/>]""")
    return (
        F.when(gps, "gps")
        .when(root["name"].isin("testsuites", "testsuite"), "junit")
        .when(root["name"] == "mxfile", "drawio")
        .when((root["name"] == "net") & net, "openvino")
        .when((root["name"] != "") & (F.lower(root["name"]) != "html"), "xml")
    )


def document_dialect(text: Column) -> Column:
    """JSON or XML dialect of a text, null when it is neither."""
    body = F.btrim(text, F.lit(WHITESPACE))
    return F.when(body.rlike(r"^[\{\[]"), json_dialect(text)).when(body.startswith("<"), xml_dialect(text))


def text_kind(text: Column) -> Column:
    """Kind of an unnamed text, null when nothing fits.

    The order of the rules is part of their meaning: line-delimited JSON, the
    JSON dialects, JSON, HTML, XML dialects, then the line-based guesses, and
    delimited text last. Documents are parsed whole.
    """
    return let(text_lines(text), lambda lines: _text_kind(text, lines))


def _text_kind(text: Column, lines: Column) -> Column:
    braced = F.get(lines, F.lit(0)).rlike(r"^[\{\[]")
    jsonl = (F.size(lines) >= 2) & F.forall(F.slice(lines, 1, 10), lambda s: is_container(strict_json(s)))
    guesses = (
        F.when(looks_like_toml(lines), "toml")
        .when(F.exists(F.slice(lines, 1, 30), lambda s: s.rlike(LATEX_CLASS)), "latex")
        .when(looks_like_mermaid(lines), "mermaid")
        .when(looks_like_plantuml(lines), "plantuml")
        .when(sniff_delimiter(F.slice(lines, 1, 10)).isNotNull(), "csv")
    )
    # coalesce stops at the first answer and computes each candidate once
    return F.when(
        F.size(lines) > 0,
        F.coalesce(
            F.when(braced & jsonl, "jsonl"),
            F.when(braced, json_dialect(text)),
            F.when(looks_like_html(text), "html"),
            F.when(looks_like_xml(text), xml_dialect(text)),
            guesses,
        ),
    )


# ------------------------------------------------------------- preview kinds

def media_magic(content: Column) -> Column:
    """Media type by leading bytes, null for anything else."""
    return let(F.hex(F.substring(content, 1, 16)), lambda h: _media_magic(content, h))


def _media_magic(content: Column, h: Column) -> Column:
    at = lambda offset, hexes: digits(h, offset, len(hexes) // 2) == hexes
    start = F.lower(F.ltrim(F.regexp_replace(utf8_text(F.substring(content, 1, 512)), "^\ufeff", ""), F.lit(WHITESPACE)))
    svg = F.when(start.startswith("<?xml"), F.contains(start, F.lit("<svg"))).otherwise(start.startswith("<svg"))
    return F.when(
        F.length(content) >= 4,
        F.when(at(0, "89504E470D0A1A0A"), "image/png")
        .when(at(0, "FFD8FF"), "image/jpeg")
        .when(at(0, "47494638"), "image/gif")
        .when(at(0, "424D"), "image/bmp")
        .when(at(0, "52494646") & at(8, "57454250"), "image/webp")
        .when(at(0, "52494646") & at(8, "57415645"), "audio/wav")
        .when(at(0, "664C6143"), "audio/flac")
        .when(at(0, "4F676753"), "audio/ogg")
        .when(at(0, "494433"), "audio/mpeg")
        .when((u8(h, 0) == 255) & (u8(h, 1) >= 0xE0), "audio/mpeg")
        .when(at(4, "66747970"), "video/mp4")
        .when(at(0, "1A45DFA3"), "video/webm")
        .when(svg, "image/svg+xml"),
    )


def _by_extension(ext: Column, table: dict[str, str]) -> Column:
    return reduce(lambda case, item: case.when(ext == item[0], item[1]), table.items(), F.when(F.lit(False), None))


def preview_kind(name: Column, content: Column) -> Column:
    """``struct(kind, mime)``: image, audio, video, text, too-large or binary."""
    seen = F.struct(extension_of(name).alias("ext"), media_magic(content).alias("magic"))
    return let(seen, lambda s: _preview_kind(s["ext"], s["magic"], content))


def _preview_kind(ext: Column, magic: Column, content: Column) -> Column:
    size = F.length(content)
    verdict = lambda kind, mime: F.struct(F.lit(kind).alias("kind"), mime.alias("mime"))
    none = F.lit(None).cast("string")
    case = F.when(size == 0, verdict("text", none))
    for kind, table in (("image", IMAGE_TYPES), ("audio", AUDIO_TYPES), ("video", VIDEO_TYPES)):
        by_name = _by_extension(ext, table)
        case = case.when(
            by_name.isNotNull() | F.coalesce(magic.startswith(kind), F.lit(False)), verdict(kind, F.coalesce(by_name, magic))
        )
    return (
        case.when(looks_like_text(content) & (size > TEXT_PREVIEW_BYTES), verdict("too-large", none))
        .when(looks_like_text(content), verdict("text", none))
        .otherwise(verdict("binary", none))
    )


def name_mismatches(classified: DataFrame) -> DataFrame:
    """The files whose content says another kind than their name; files without a known extension have none."""
    return classified.where(
        F.col("by_signature") & F.col("ext_kind").isNotNull() & (F.col("ext_kind") != F.col("kind"))
    ).withColumnRenamed("ext_kind", "named_kind")


def corpus_report(classified: DataFrame) -> DataFrame:
    """Files, bytes, byte share and name/content disagreements per kind."""
    by_kind = classified.groupBy("kind").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.count_if(F.col("by_signature")).alias("by_signature"),
        F.count_if(F.col("ext_kind").isNotNull() & (F.col("ext_kind") != F.col("kind"))).alias("mismatches"),
    )
    # One row per kind is left here, a few dozen at most.
    return by_kind.withColumn("byte_share", F.col("bytes") / F.sum("bytes").over(Window.partitionBy()))
