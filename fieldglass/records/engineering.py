"""Bus logs, network databases and inventories of engineering texts.

The functions take documents as rows and work on their lines, so every output
row keeps the document's keys and its line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.cells import trimmed
from fieldglass.functions.formatting import unescape_xml
from fieldglass.functions.xml_walk import element_rows
from fieldglass.sources.lines import document_lines

def _word(i: int | Column) -> Column:
    return F.get(F.col("_w"), F.lit(i) if isinstance(i, int) else i)


def _digits(word: Column) -> Column:
    return F.coalesce(word.rlike("^[0-9]+$"), F.lit(False))


def _frame_id(word: Column) -> Column:
    """A hexadecimal identifier; extended ones end with ``x``."""
    return F.coalesce(word.rlike("^[0-9A-Fa-f]+x?$"), F.lit(False))


def can_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Non-blank lines of a CAN text log with their kind: header, event.

    An event starts with its time in seconds, followed by something.
    """
    lines = document_lines(df, keys, text).withColumn("raw", trimmed(F.col("raw"))).where("raw <> ''")
    words = F.split("raw", r"\s+")
    timed = F.get(words, F.lit(0)).rlike("^[0-9]+([.][0-9]+)?$") & (F.size(words) > 1)
    return lines.withColumn("kind", F.when(timed, "event").otherwise("header"))


def can_events(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Classic and FD frames; timed lines of any other form are left out.

    A classic frame is: time, channel, identifier, direction, ``d``, length code,
    data. In an FD line the identifier is the first hexadecimal word behind the
    direction; its length code follows, and the data starts five words on.
    """
    behind = F.slice("_w", F.lit(4), F.size("_w"))
    spot = F.array_position(F.transform(behind, _frame_id), True).cast("int")
    timed = (
        lines.where("kind = 'event'")
        .withColumn("_w", F.split("raw", r"\s+"))
        .withColumn("_fd", _word(1) == "CANFD")
        .withColumn("_id", F.when(spot > 0, spot + 2))
    )
    classic = (
        _digits(_word(1))
        & _frame_id(_word(2))
        & F.coalesce(_word(3).isin("Rx", "Tx"), F.lit(False))
        & F.coalesce(_word(4) == "d", F.lit(False))
        & _digits(_word(5))
    )
    rest = lambda start: F.array_join(
        F.slice("_w", start, F.greatest(F.size("_w") - start + 1, F.lit(0))), " "
    )
    fd = F.col("_fd")
    return timed.where(fd | classic).select(
        *keys,
        _word(0).alias("time"),
        F.when(fd, "CANFD").otherwise("CAN").alias("type"),
        F.when(fd, F.coalesce(_word(2), F.lit("-"))).otherwise(_word(1)).alias("channel"),
        F.when(fd, F.coalesce(_word(3), F.lit("-"))).otherwise(_word(3)).alias("dir"),
        F.when(fd, F.coalesce(_word(F.col("_id")), F.lit("-"))).otherwise(_word(2)).alias("can_id"),
        F.when(fd, F.coalesce(_word(F.col("_id") + 1), F.lit("-"))).otherwise(_word(5)).alias("dlc"),
        F.when(fd, F.coalesce(rest(F.col("_id") + 6), F.lit(""))).otherwise(rest(F.lit(7))).alias("data"),
        F.col("line_no").alias("line"),
    )


# ------------------------------------------------------- network databases

# A statement is read as tokens: quoted texts, names, numbers and single marks.
TOKEN = r'"(?:[^"\\]|\\.)*+"|[A-Za-z_][\w.]*|[-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][-+]?[0-9]+)?|\S'
# Frame numbers above this one are extended.
STANDARD_FRAMES = 0x7FF


def _plain(text: Column) -> Column:
    """What a quoted text says."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def _token(i: int | Column) -> Column:
    return F.get("_t", F.lit(i) if isinstance(i, int) else i)


def _reads(*want: tuple[int | Column, str]) -> Column:
    """Whether the tokens at these places are these words; ``#`` is a whole number, ``"`` a text, ``a`` a name."""
    holds = F.lit(True)
    for place, word in want:
        token = _token(place)
        if word == "#":
            fits = token.rlike("^[0-9]+$")
        elif word == '"':
            fits = token.startswith('"') & (F.length(token) > 1)
        elif word == "a":
            fits = token.rlike("^[A-Za-z_]")
        else:
            fits = token == word
        holds = holds & F.coalesce(fits, F.lit(False))
    return holds


def _is_message() -> Column:
    return _reads((0, "BO_"), (1, "#"), (2, "a"), (3, ":"), (4, "#")) & _token(5).isNotNull()


def _colon() -> Column:
    """Where the colon of a signal stands: behind its name or its multiplexer."""
    return F.when(_token(2) == ":", 2).otherwise(3)


def _is_signal() -> Column:
    c = _colon()
    marks = zip((0, 1, 2, 3, 4, 7, 9, 11, 12, 14, 16, 17), (":", "#", "|", "#", "@", "(", ",", ")", "[", "|", "]", '"'), strict=True)
    shape = _reads((0, "SG_"), (1, "a"), *[(c + step, word) for step, word in marks])
    signs = F.coalesce(_token(c + 5).isin("0", "1") & _token(c + 6).isin("+", "-"), F.lit(False))
    return shape & signs


def _is_values() -> Column:
    return _reads((0, "VAL_"), (1, "#"), (2, "a"), (F.size("_t") - 1, ";")) & (F.size("_t") > 4)


def _tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Non-blank lines with their tokens."""
    lines = document_lines(df, keys, text).withColumn("raw", trimmed(F.col("raw"))).where("raw <> ''")
    return lines.withColumn("_t", F.regexp_extract_all("raw", F.lit(TOKEN), 0))


def dbc_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Non-blank lines with their tokens and the message they stand under."""
    lines = _tokens(df, keys, text)
    own = F.when(_is_message(), _token(1).cast("long"))
    # A document is one row of the input, so its lines fit one window group.
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("message_id", F.last(own, ignorenulls=True).over(before))


def dbc_comments(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Comments on messages and signals."""
    on_message = _reads((0, "CM_"), (1, "BO_"), (2, "#"), (3, '"'), (4, ";"))
    on_signal = _reads((0, "CM_"), (1, "SG_"), (2, "#"), (3, "a"), (4, '"'), (5, ";"))
    return lines.where(on_message | on_signal).select(
        *keys,
        F.when(on_message, "message").otherwise("signal").alias("target"),
        _token(2).cast("long").alias("message_id"),
        F.when(~on_message, _token(3)).alias("signal"),
        _plain(F.when(on_message, _token(3)).otherwise(_token(4))).alias("text"),
        F.col("line_no").alias("line"),
    )


def dbc_messages(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Messages with their last comment."""
    messages = lines.where(_is_message()).select(
        *keys,
        "message_id",
        F.concat(F.lit("0x"), F.hex("message_id")).alias("id_hex"),
        _token(2).alias("name"),
        _token(4).cast("long").alias("dlc"),
        _token(5).alias("transmitter"),
        F.col("line_no").alias("line"),
    )
    notes = (
        dbc_comments(lines, keys)
        .where("target = 'message'")
        .groupBy(*keys, "message_id")
        .agg(F.max_by("text", "line").alias("comment"))
    )
    return messages.join(notes, [*keys, "message_id"], "left")


def dbc_signals(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Signals with the message they stand under and their last comment."""
    c = _colon()
    receivers = F.filter(F.slice("_t", c + 19, F.size("_t")), lambda t: t != ",")
    signals = lines.where(_is_signal()).select(
        *keys,
        "message_id",
        _token(1).alias("signal"),
        F.when(c == 3, _token(2)).alias("multiplexer"),
        _token(c + 1).cast("long").alias("start_bit"),
        _token(c + 3).cast("long").alias("length"),
        F.when(_token(c + 5) == "1", "little_endian").otherwise("big_endian").alias("byte_order"),
        F.when(_token(c + 6) == "+", "unsigned").otherwise("signed").alias("value_type"),
        _token(c + 8).try_cast("double").alias("factor"),
        _token(c + 10).try_cast("double").alias("offset"),
        _token(c + 13).try_cast("double").alias("minimum"),
        _token(c + 15).try_cast("double").alias("maximum"),
        _plain(_token(c + 17)).alias("unit"),
        receivers.alias("receivers"),
        F.col("line_no").alias("line"),
    )
    notes = (
        dbc_comments(lines, keys)
        .where("target = 'signal'")
        .groupBy(*keys, "message_id", "signal")
        .agg(F.max_by("text", "line").alias("comment"))
    )
    return signals.join(notes, [*keys, "message_id", "signal"], "left")


def dbc_values(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per entry of a value table."""
    pairs = F.sequence(F.lit(3), F.size("_t") - 3, F.lit(2))
    entries = F.transform(pairs, lambda i: F.struct(_token(i).alias("v"), _token(i + 1).alias("l")))
    tables = lines.where(_is_values()).select(
        *keys,
        _token(1).cast("long").alias("message_id"),
        _token(2).alias("signal"),
        F.explode(F.filter(entries, lambda e: e["l"].startswith('"'))).alias("e"),
        F.col("line_no").alias("line"),
    )
    return tables.select(
        *keys, "message_id", "signal", F.col("e.v").cast("long").alias("value"), _plain(F.col("e.l")).alias("label"), "line"
    )


def dbc_nodes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes of the network in order."""
    names = F.filter(F.slice("_t", F.lit(3), F.size("_t")), lambda t: t.rlike("^[A-Za-z_]"))
    return lines.where(_reads((0, "BU_"), (1, ":"))).select(
        *keys, F.posexplode(names).alias("idx", "node"), F.col("line_no").alias("line")
    )


def dbc_header(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Version and bus line of each document; of several the last counts."""
    version = F.when(_reads((0, "VERSION"), (1, '"')), _plain(_token(1)))
    bus = F.when(_reads((0, "BS_"), (1, ":")), trimmed(F.regexp_replace("raw", r"^BS_\s*:", "")))
    last = lambda c, name: F.max_by(c, F.when(c.isNotNull(), F.col("line_no"))).alias(name)
    return lines.groupBy(*keys).agg(last(version, "version"), last(bus, "bus"))


def dbc_signal_values(signals: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """The signals with the entries of their value table, in its order; of several tables the last counts."""
    pairs = F.sequence(F.lit(3), F.size("_t") - 3, F.lit(2))
    entries = F.transform(pairs, lambda i: F.struct(_token(i).cast("long").alias("value"), _token(i + 1).alias("label")))
    named = F.transform(
        F.filter(entries, lambda e: e["label"].startswith('"')),
        lambda e: F.struct(e["value"].alias("value"), _plain(e["label"]).alias("label")),
    )
    tables = (
        lines.where(_is_values())
        .groupBy(*keys, _token(1).cast("long").alias("message_id"), _token(2).alias("signal"))
        .agg(F.max_by(named, "line_no").alias("values"))
    )
    return signals.join(tables, [*keys, "message_id", "signal"], "left")


def dbc_warnings(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Value tables without their signal, and signals before any message."""
    signals = lines.where(_is_signal()).select(*keys, "message_id", _token(1).alias("signal"), F.col("line_no").alias("line"))
    tables = lines.where(_is_values()).select(
        *keys,
        _token(1).cast("long").alias("message_id"),
        _token(2).alias("signal"),
        F.col("line_no").alias("line"),
    )
    lost = tables.join(signals.select(*keys, "message_id", "signal").distinct(), [*keys, "message_id", "signal"], "left_anti")
    early = signals.where("message_id IS NULL")
    return lost.select(*keys, "line", "signal", F.lit("value table without its signal").alias("warning")).unionByName(
        early.select(*keys, "line", "signal", F.lit("signal before any message").alias("warning"))
    )


def dbc_filter(messages: DataFrame, signals: DataFrame, keys: list[str], node: str = "", query: str = "") -> DataFrame:
    """Messages a node sends or receives, with the query in any of their texts."""
    gathered = signals.groupBy(*keys, "message_id").agg(
        F.array_distinct(F.flatten(F.collect_list("receivers"))).alias("_receivers"),
        F.array_join(
            F.collect_list(F.concat_ws(" ", "signal", "unit", "comment", F.array_join("receivers", " "))), " "
        ).alias("_texts"),
    )
    out = messages.join(gathered, [*keys, "message_id"], "left")
    if node:
        out = out.where((F.col("transmitter") == node) | F.coalesce(F.array_contains("_receivers", node), F.lit(False)))
    if query.strip():
        text = F.concat_ws(" ", "name", F.col("message_id").cast("string"), "id_hex", "transmitter", "comment", "_texts")
        out = out.where(F.contains(F.lower(text), F.lit(query.strip().lower())))
    return out.select(*messages.columns)


def dbc_summary(messages: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """Messages, extended messages, largest length and signals per document."""
    per_message = messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("message_id") > STANDARD_FRAMES).alias("extended"),
        F.max("dlc").alias("max_dlc"),
    )
    per_signal = signals.groupBy(*keys).agg(F.count(F.lit(1)).alias("signals"))
    return per_message.join(per_signal, keys, "left").fillna(0, ["signals"])


def dbc_totals(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """What ``dbc_summary`` gives, counted in one pass over the lines: no message needs its signals or comments."""
    read = _tokens(df, keys, text).select(*keys, "_t", _is_message().alias("_m"), _is_signal().alias("_s"))
    number = lambda i: F.when(F.col("_m"), _token(i).cast("long"))
    told = read.select(*keys, "_m", "_s", number(1).alias("_id"), number(4).alias("_dlc"))
    return (
        told.groupBy(*keys)
        .agg(
            F.count_if("_m").alias("messages"),
            F.count_if(F.col("_id") > STANDARD_FRAMES).alias("extended"),
            F.max("_dlc").alias("max_dlc"),
            F.count_if("_s").alias("signals"),
        )
        .where("messages > 0")
    )


# ----------------------------------------------------------------- inventories

A2L_BLOCK = r'^\s*/begin\s+([A-Za-z0-9_]+)(?:\s+("[^"]+"|\S+))?'
# Block kinds listed as important.
A2L_FOCUS = "PROJECT MODULE IF_DATA MEASUREMENT CHARACTERISTIC COMPU_METHOD RECORD_LAYOUT EVENT".split()
STEP_ENTITY = r"(?i)^\s*#([0-9]+)\s*=\s*([A-Z0-9_]+)\s*\("
# Named element kinds of system descriptions.
ARXML_KINDS = (
    "CAN-CLUSTER CAN-PHYSICAL-CHANNEL CAN-FRAME-TRIGGERING FRAME I-SIGNAL I-PDU SIGNAL-I-PDU ECU-INSTANCE".split()
)


def a2l_blocks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Blocks with kind, name and line."""
    part = lambda i: F.regexp_extract("raw", A2L_BLOCK, i)
    return document_lines(df, keys, text).where(F.col("raw").rlike(A2L_BLOCK)).select(
        *keys,
        F.upper(part(1)).alias("kind"),
        F.regexp_replace(part(2), '^"|"$', "").alias("name"),
        F.upper(part(1)).isin(A2L_FOCUS).alias("important"),
        F.col("line_no").alias("line"),
    )


def step_entities(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Entity lines with number and type."""
    part = lambda i: F.regexp_extract("raw", STEP_ENTITY, i)
    return document_lines(df, keys, text).where(F.col("raw").rlike(STEP_ENTITY)).select(
        *keys, F.concat(F.lit("#"), part(1)).alias("entity"), F.upper(part(2)).alias("kind"), F.col("line_no").alias("line")
    )


def step_header(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """The header section: name, time, authors, organisations, the three further fields of the name, and schemas.

    Texts may hold any character, semicolons and brackets too; several authors,
    organisations or schemas are joined by commas. An omitted argument (``$``) is null.
    """
    quoted = r"'(?:[^']|'')*+'"
    section = lambda word: F.regexp_extract(text, rf"(?is)\b{word}\s*\(((?:{quoted}|[^';])*+)(?<=\))\s*;", 1)
    plain = lambda v: F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))

    def arguments(word: str) -> Column:
        """Each argument as its texts; null where it is omitted."""
        found = F.regexp_extract_all(section(word), F.lit(rf"\((?:{quoted}|[^'()])*+\)|{quoted}|\$"), F.lit(0))
        texts = lambda v: F.transform(F.regexp_extract_all(v, F.lit(quoted), F.lit(0)), plain)
        return F.transform(found, lambda v: F.when(v != "$", F.array_join(texts(v), ", ")))

    given = df.select(*keys, arguments("FILE_NAME").alias("_name"), arguments("FILE_SCHEMA").alias("_schema"))
    fields = ("name", "timestamp", "author", "organization", "preprocessor", "system", "authorization")
    return given.select(
        *keys, *[F.get("_name", F.lit(i)).alias(f) for i, f in enumerate(fields)], F.get("_schema", F.lit(0)).alias("schema")
    )


def arxml_elements(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Packages and named elements with their short names.

    ``path`` joins the short names of the elements around, packages inside packages
    included, and the element's own, as references spell it.
    """
    kinds = ["AR-PACKAGE", *ARXML_KINDS]
    named = element_rows(df, keys, text, kinds, name_tag="SHORT-NAME").where("element.name IS NOT NULL")
    return named.withColumnRenamed("element", "_e").select(
        *keys,
        F.col("_e.tag").alias("kind"),
        F.col("_e.name").alias("name"),
        F.concat("_e.base", F.lit("/"), "_e.name").alias("path"),
    )


def arxml_references(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """References with tag, kind of the target and target path."""
    pattern = r"(?s)<([A-Z0-9-]*REF)\b([^>]*)>(.*?)</\1>"
    group = lambda i: F.regexp_extract_all(text, F.lit(pattern), i)
    rows = F.arrays_zip(group(1).alias("tag"), group(2).alias("attributes"), group(3).alias("target"))
    return df.select(*keys, F.inline(rows)).select(
        *keys,
        "tag",
        F.regexp_extract("attributes", r'\bDEST="([^"]+)"', 1).alias("dest"),
        unescape_xml(trimmed(F.col("target"))).alias("target"),
    )


# Element patterns of requirement documents.
REQIF_KINDS = ("SPEC-OBJECT", "SPECIFICATION", "SPEC-RELATION", "DATATYPE-DEFINITION-[A-Z-]+", "SPEC-[A-Z-]*TYPE")


def reqif_elements(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Objects, specifications, relations and definitions with their attributes."""
    pattern = rf"(?i)<({'|'.join(REQIF_KINDS)})(?!-)\b([^>]*)>"
    group = lambda i: F.regexp_extract_all(text, F.lit(pattern), i)
    rows = F.arrays_zip(group(1).alias("kind"), group(2).alias("attributes"))
    attribute = lambda name: F.regexp_extract("attributes", rf'(?i)\b{name}="([^"]*)"', 1)
    shown = lambda c: F.when(c == "", "-").otherwise(c)
    return df.select(*keys, F.inline(rows)).select(
        *keys,
        F.upper("kind").alias("kind"),
        shown(attribute("IDENTIFIER")).alias("identifier"),
        unescape_xml(shown(attribute("LONG-NAME"))).alias("long_name"),
    )


def reqif_header(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Title, identifier, tools, comment and creation time of the header."""
    head = F.regexp_extract(text, r"(?is)(<REQ-IF-HEADER\b[^>]*>.*?</REQ-IF-HEADER>)", 1)
    tag = lambda name: unescape_xml(trimmed(F.regexp_extract(head, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)))
    return df.select(
        *keys,
        tag("TITLE").alias("title"),
        F.regexp_extract(head, r'(?i)\bIDENTIFIER="([^"]*)"', 1).alias("identifier"),
        tag("COMMENT").alias("comment"),
        tag("REQ-IF-TOOL-ID").alias("tool"),
        tag("SOURCE-TOOL-ID").alias("source_tool"),
        tag("CREATION-TIME").alias("created"),
    )
