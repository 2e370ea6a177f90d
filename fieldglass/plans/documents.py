"""Nested documents, line-delimited JSON, text kinds, formats and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions import formatting as fmt
from fieldglass.functions.cells import WHITESPACE, hex_preview, natural_key, number_or_null
from fieldglass.functions.json_text import allow_duplicate_keys, line_kind
from fieldglass.operators import classify, integrity, nested
from fieldglass.plans import shapes
from fieldglass.plans.registry import query, table
from fieldglass.sources.lines import decoded_text, document_lines, preview

_KIND = (
    "CASE WHEN j.type = 'OBJECT' THEN 'object' WHEN j.type = 'ARRAY' THEN 'array' WHEN j.type = 'VARCHAR' THEN 'string' "
    "WHEN j.type = 'BOOLEAN' THEN 'boolean' WHEN j.type = 'NULL' THEN 'null' ELSE 'number' END"
)
_POINTER = "replace(regexp_replace(substr(j.fullkey, 2), '[.\\[]', '/', 'g'), ']', '')"


def nodes_sql(source: str, key: str, text: str) -> str:
    return (
        f"SELECT {key}, path, CASE WHEN path = '' THEN NULL ELSE regexp_replace(path, '/[^/]*$', '') END AS parent_path, "
        f"key, kind, CASE WHEN kind IN ('object', 'array') THEN NULL WHEN kind = 'number' THEN "
        f"regexp_replace(atom, '\\.0$', '') ELSE atom END AS primitive, "
        f"CAST(length(path) - length(replace(path, '/', '')) AS INTEGER) AS depth FROM ("
        f"SELECT s.{key}, {_POINTER} AS path, coalesce(CAST(j.key AS VARCHAR), '$') AS key, {_KIND} AS kind, "
        f"CASE WHEN j.type = 'NULL' THEN 'null' ELSE CAST(j.value AS VARCHAR) END AS atom FROM {source} s, json_tree(s.{text}) j) t"
    )


_NODE_COLUMNS = ["path", "parent_path", "key", "kind", "primitive", "depth"]
_ORDER_NODES = f"({nodes_sql(shapes.ORDER_DOCS_SQL, 'o_orderkey', 'body')})"


def _order_nodes(spark, sf):
    allow_duplicate_keys(spark)
    return nested.node_table(shapes.order_docs(spark, sf), ["o_orderkey"], F.col("body"))


@query("json_nodes", nodes_sql("events", "event_id", "props"))
def json_nodes(spark, sf):
    allow_duplicate_keys(spark)
    return nested.node_table(table(spark, sf, "events"), ["event_id"], F.col("props")).select("event_id", *_NODE_COLUMNS)


@query("json_nodes_nested", nodes_sql(shapes.ORDER_DOCS_SQL, "o_orderkey", "body"))
def json_nodes_nested(spark, sf):
    return _order_nodes(spark, sf).select("o_orderkey", *_NODE_COLUMNS)


@query(
    "json_depth_cut",
    f"SELECT n.o_orderkey, n.path, n.kind IN ('object', 'array') AND n.depth = 1 AS truncated FROM {_ORDER_NODES} n WHERE n.depth <= 1",
)
def json_depth_cut(spark, sf):
    allow_duplicate_keys(spark)
    cut = nested.node_table(shapes.order_docs(spark, sf), ["o_orderkey"], F.col("body"), depth=1)
    return cut.select("o_orderkey", "path", "truncated")


_SEARCHED = "contains(lower(key), 'low') OR contains(lower(coalesce(primitive, '')), 'low')"


@query("json_search", f"SELECT o_orderkey, path, key, primitive FROM {_ORDER_NODES} n WHERE {_SEARCHED}")
def json_search(spark, sf):
    return nested.search_nodes(_order_nodes(spark, sf), " LOW ").select("o_orderkey", "path", "key", "primitive")


@query(
    "json_match_ancestors",
    f"WITH n AS {_ORDER_NODES}, m AS (SELECT o_orderkey, path FROM n WHERE {_SEARCHED} OR contains(lower(key), 'qty')) "
    "SELECT DISTINCT n.o_orderkey, n.path FROM n JOIN m ON n.o_orderkey = m.o_orderkey AND n.kind IN ('object', 'array') "
    "AND m.path <> n.path AND starts_with(m.path, concat(n.path, '/'))",
)
def json_match_ancestors(spark, sf):
    nodes = _order_nodes(spark, sf)
    return nested.match_ancestors(nested.search_nodes(nodes, "low", "qty"), ["o_orderkey"])


@query(
    "key_union",
    f"SELECT key, count(*) AS documents FROM (SELECT unnest(json_keys(body)) AS key FROM {shapes.ORDER_DOCS_SQL} d) k GROUP BY 1",
)
def key_union(spark, sf):
    allow_duplicate_keys(spark)
    return nested.key_union(shapes.order_docs(spark, sf), F.col("body"))


# A document per event with spaces, unsorted and repeated keys.
_LOOSE = (
    "concat('{ \"b\" : ', event_id, ', \"a\": [1, {\"z\" : \"x  y\", \"c\": ', props, '} ],\\n \"b\": ', event_id + 1, ' }')"
)


def _loose_docs(spark, sf):
    allow_duplicate_keys(spark)
    events = table(spark, sf, "events")
    return events.select("event_id", F.expr(_LOOSE.replace("\\n", "\n")).alias("body"))


@query(
    "json_canonical",
    "SELECT event_id, concat('{\"a\":[1,{\"c\":', json(props), ',\"z\":\"x  y\"}],\"b\":', event_id + 1, '}') AS body FROM events",
)
def json_canonical(spark, sf):
    return _loose_docs(spark, sf).select("event_id", nested.canonical_json(F.col("body")).alias("body"))


@query(
    "json_minify",
    "SELECT event_id, concat('{\"b\":', event_id, ',\"a\":[1,{\"z\":\"x  y\",\"c\":', json(props), '}],\"b\":', event_id + 1, '}') "
    "AS body FROM events",
)
def json_minify(spark, sf):
    return _loose_docs(spark, sf).select("event_id", nested.minified_json(F.col("body")).alias("body"))


def _lines_sql(*lines: str) -> str:
    return "concat(" + ", chr(10), ".join(lines) + ")"


@query(
    "json_pretty",
    "SELECT o_orderkey, "
    + _lines_sql(
        "'{'",
        "'  \"amounts\": ['",
        "'    {'",
        "'      \"code\": ', o_orderkey, ','",
        "'      \"qty\": ', o_orderkey % 7",
        "'    },'",
        "'    {'",
        "'      \"code\": ', o_custkey % 5, ','",
        "'      \"qty\": ', regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '')",
        "'    }'",
        "'  ],'",
        "'  \"customer\": {'",
        "'    \"key\": ', o_custkey, ','",
        "'    \"tags\": {'",
        "'      \"priority\": \"', o_orderpriority, '\",'",
        "'      \"status\": \"', o_orderstatus, '\"'",
        "'    }'",
        "'  },'",
        "'  \"even\": ', CAST(o_orderkey % 2 = 0 AS VARCHAR), ','",
        "'  \"note\": null'",
        "'}'",
    )
    + " AS pretty FROM orders",
)
def json_pretty(spark, sf):
    allow_duplicate_keys(spark)
    return nested.pretty_json(shapes.order_docs(spark, sf), ["o_orderkey"], F.col("body"))


@query(
    "json_to_yaml",
    "SELECT o_orderkey, "
    + _lines_sql(
        "'amounts: '",
        "'  - '",
        "'    code: ', o_orderkey",
        "'    qty: ', o_orderkey % 7",
        "'  - '",
        "'    code: ', o_custkey % 5",
        "'    qty: ', regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '')",
        "'customer: '",
        "'  key: ', o_custkey",
        "'  tags: '",
        "'    priority: \"', o_orderpriority, '\"'",
        "'    status: \"', o_orderstatus, '\"'",
        "'even: ', CAST(o_orderkey % 2 = 0 AS VARCHAR)",
        "'note: null'",
    )
    + " AS yaml FROM orders",
)
def json_to_yaml(spark, sf):
    allow_duplicate_keys(spark)
    return nested.json_to_yaml(shapes.order_docs(spark, sf), ["o_orderkey"], F.col("body"))


@query(
    "json_to_xml",
    "SELECT o_orderkey, concat('<root><amounts><item><code>', o_orderkey, '</code><qty>', o_orderkey % 7, '</qty></item>"
    "<item><code>', o_custkey % 5, '</code><qty>', regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', ''), "
    "'</qty></item></amounts><customer><key>', o_custkey, '</key><tags><priority>', o_orderpriority, '</priority><status>', "
    "o_orderstatus, '</status></tags></customer><even>', CAST(o_orderkey % 2 = 0 AS VARCHAR), '</even><note></note></root>') "
    "AS xml FROM orders",
)
def json_to_xml(spark, sf):
    allow_duplicate_keys(spark)
    return nested.json_to_xml(shapes.order_docs(spark, sf), ["o_orderkey"], F.col("body"))


@query(
    "json_to_csv",
    "SELECT p_partkey, concat('\"size\",\"name\",\"more\"', chr(10), '\"', p_size, '\",\"', p_name, '\",\"\"', chr(10), "
    "'\"\",\"a \"\"b\"\"\",\"[1,2]\"') AS csv FROM part",
)
def json_to_csv(spark, sf):
    allow_duplicate_keys(spark)
    body = F.expr(
        "concat('[{\"size\":', p_size, ',\"name\":\"', p_name, '\"}, 5, {\"name\":\"a \\\\\"b\\\\\"\",\"size\":null,\"more\":[1,2]}]')"
    )
    return table(spark, sf, "part").select("p_partkey", nested.json_to_csv(body).alias("csv"))


# ------------------------------------------------------- line-delimited JSON


@query("jsonl_lines", f"SELECT doc_id, line_no, raw FROM {shapes.LINE_DOCS_SQL} l")
def jsonl_lines(spark, sf):
    return document_lines(shapes.line_docs(spark, sf), ["doc_id"], "body")


_LINE_KIND = "CASE WHEN trim(raw) = '' THEN 'empty' WHEN json_valid(raw) THEN 'valid' ELSE 'invalid' END"


def _kinds(spark, sf):
    allow_duplicate_keys(spark)
    lines = document_lines(shapes.line_docs(spark, sf), ["doc_id"], "body")
    return lines.withColumn("kind", line_kind(F.col("raw")))


@query("jsonl_validate", f"SELECT doc_id, line_no, {_LINE_KIND} AS kind FROM {shapes.LINE_DOCS_SQL} l")
def jsonl_validate(spark, sf):
    return _kinds(spark, sf).select("doc_id", "line_no", "kind")


@query(
    "jsonl_quarantine",
    f"SELECT doc_id, line_no, raw FROM {shapes.LINE_DOCS_SQL} l WHERE {_LINE_KIND} = 'invalid'",
)
def jsonl_quarantine(spark, sf):
    return _kinds(spark, sf).where("kind = 'invalid'").select("doc_id", "line_no", "raw")


@query(
    "jsonl_kind_counts",
    f"SELECT kind, count(*) AS n FROM (SELECT {_LINE_KIND} AS kind FROM {shapes.LINE_DOCS_SQL} l) k GROUP BY 1",
)
def jsonl_kind_counts(spark, sf):
    return _kinds(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jsonl_apply_edits",
    "SELECT doc_id, line_no, CASE WHEN event_id % 29 = 0 THEN concat('{\"edited\": ', event_id, '}') ELSE raw END AS raw "
    f"FROM {shapes.LINE_DOCS_SQL} l",
)
def jsonl_apply_edits(spark, sf):
    """Two edits for every 29th event, the later one wins; others miss every line."""
    lines = document_lines(shapes.line_docs(spark, sf), ["doc_id"], "body")
    k = F.col("event_id")
    at = [F.floor(k / 100).cast("long").alias("doc_id"), (k % 100 + 1).alias("line_no")]
    events = table(spark, sf, "events").where("event_id % 29 = 0")
    first = events.select(*at, F.lit(1).alias("edit_no"), F.lit("draft").alias("new_raw"))
    second = events.select(
        *at, F.lit(2).alias("edit_no"), F.concat(F.lit('{"edited": '), k.cast("string"), F.lit("}")).alias("new_raw")
    )
    outside = events.select(at[0], (k % 100 + 5001).alias("line_no"), F.lit(3).alias("edit_no"), F.lit("lost").alias("new_raw"))
    return integrity.apply_edits(lines, first.unionByName(second).unionByName(outside), ["doc_id", "line_no"])


@query(
    "offset_to_line_col",
    "WITH d AS (SELECT doc_id, text, CAST((doc_id * 37) % (length(text) + 50) - 5 AS BIGINT) AS off FROM documents) "
    "SELECT doc_id, CASE WHEN off < 0 OR off > length(text) THEN 1 ELSE len(regexp_extract_all(left(text, off), '\\r\\n|\\r|\\n')) "
    "+ 1 END AS line, CASE WHEN off < 0 OR off > length(text) THEN 1 ELSE "
    "length(regexp_extract(left(text, off), '[^\\r\\n]*$')) + 1 END AS col FROM d",
)
def offset_to_line_col(spark, sf):
    docs = table(spark, sf, "documents")
    offset = ((F.col("doc_id") * 37) % (F.length("text") + 50) - 5).cast("int")
    return docs.select("doc_id", nested.line_and_column(F.col("text"), offset).alias("at")).select("doc_id", "at.line", "at.col")


@query(
    "text_codecs",
    "SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS escaped, text AS unescaped, to_base64(encode(text)) AS base64, "
    "text AS from_base64 FROM documents",
)
def text_codecs(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", nested.json_escape(F.col("text")).alias("escaped"), F.base64(F.encode("text", "UTF-8")).alias("b64")
    )
    return docs.select(
        "doc_id",
        "escaped",
        nested.json_unescape(F.col("escaped")).alias("unescaped"),
        F.replace(F.replace("b64", F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")).alias("base64"),
        F.decode(F.unbase64("b64"), "UTF-8").alias("from_base64"),
    )


# ----------------------------------------------------------- text and scalars


@query(
    "text_preview",
    "SELECT doc_id, left(text, 200) AS preview, length(text) > 200 AS truncated FROM documents",
)
def text_preview(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", preview(F.col("text"), 200).alias("p")).select("doc_id", "p.*")


@query("text_decode", "SELECT doc_id, text FROM documents")
def text_decode(spark, sf):
    """Texts written as UTF-8, UTF-16LE and UTF-16BE with their marks, read back."""
    body = F.col("text")
    mark = lambda h: F.unhex(F.lit(h))
    content = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(mark("EFBBBF"), F.encode(body, "UTF-8")))
        .when(F.col("doc_id") % 3 == 1, F.concat(mark("FFFE"), F.encode(body, "UTF-16LE")))
        .otherwise(F.concat(mark("FEFF"), F.encode(body, "UTF-16BE")))
    )
    return table(spark, sf, "documents").select("doc_id", decoded_text(content).alias("text"))


_SIZE = (
    "CASE WHEN {b} = 0 THEN '0 B' WHEN {b} < 1024 THEN concat(CAST({b} AS BIGINT), ' B') WHEN {b} < 1048576 THEN "
    "printf('%.1f KB', floor({b} / 1024.0 * 10 + 0.5) / 10) WHEN {b} < 1073741824 THEN printf('%.1f MB', floor({b} / 1048576.0 * 10 + 0.5) / 10) "
    "ELSE printf('%.1f GB', floor({b} / 1073741824.0 * 10 + 0.5) / 10) END"
)
_STAT = "regexp_replace(printf('%.4f', {x}), '\\.?0+$', '')"


@query(
    "scalar_pack_events",
    "SELECT event_id, "
    + _SIZE.format(b="(event_id * event_id * 37)")
    + " AS size, "
    + _STAT.format(x="value")
    + " AS stat, concat(regexp_replace(printf('%.1f', (event_id % 1000) / 10.0), '\\.0$', ''), '%') AS percent, "
    "CASE WHEN event_id * event_id * 37 >= 157286400 THEN 'blocked' WHEN event_id * event_id * 37 >= 52428800 THEN 'limited' "
    "ELSE 'small' END AS bucket, CAST(event_id AS DOUBLE) / 2 / 16000 AS pcm_seconds FROM events",
)
def scalar_pack_events(spark, sf):
    size = F.col("event_id") * F.col("event_id") * 37
    return table(spark, sf, "events").select(
        "event_id",
        fmt.format_size(size).alias("size"),
        fmt.format_stat(F.col("value")).alias("stat"),
        fmt.format_percent((F.col("event_id") % 1000) / 1000).alias("percent"),
        fmt.size_bucket(size).alias("bucket"),
        fmt.pcm_seconds(F.col("event_id")).alias("pcm_seconds"),
    )


@query(
    "scalar_pack_pages",
    "SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(tar\\.gz|sarif\\.json|trace\\.json|cdx\\.json|cyclonedx\\.json)$') "
    "THEN regexp_extract(lower(url), '(\\.(tar\\.gz|sarif\\.json|trace\\.json|cdx\\.json|cyclonedx\\.json))$', 1) "
    "ELSE regexp_extract(lower(url), '(\\.[^.]*)$', 1) END AS ext, "
    "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped, "
    "html AS unescaped FROM pages",
)
def scalar_pack_pages(spark, sf):
    escaped = fmt.escape_xml(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id",
        fmt.extension_of(F.col("url")).alias("ext"),
        escaped.alias("escaped"),
        fmt.unescape_xml(escaped).alias("unescaped"),
    )


@query(
    "scalar_pack_documents",
    "WITH d AS (SELECT doc_id, text, lower(hex(encode(text))) AS h FROM documents) SELECT doc_id, "
    "concat(rtrim(regexp_replace(left(h, 32), '(..)', '\\1 ', 'g')), CASE WHEN length(h) > 32 THEN "
    "concat('… (', length(h) // 2, ' bytes)') ELSE '' END) AS hex, NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0e-\\x1f]') "
    "AS textual, length(regexp_replace(regexp_replace(text, '\"[^\"]*(\"|$)', '', 'g'), '[^,]', '', 'g')) AS commas FROM d",
)
def scalar_pack_documents(spark, sf):
    content = F.encode("text", "UTF-8")
    outside = F.regexp_replace("text", r'"[^"]*("|\z)', "")
    return table(spark, sf, "documents").select(
        "doc_id",
        fmt.binary_preview(content).alias("hex"),
        fmt.looks_like_text(content).alias("textual"),
        F.regexp_count(outside, F.lit(",")).cast("long").alias("commas"),
    )


_NUMERIC_TEXT = (
    "CASE o_orderkey % 10 WHEN 0 THEN concat('0x', printf('%x', o_custkey)) WHEN 1 THEN concat(' ', o_custkey, '.5 ') "
    "WHEN 9 THEN concat('0x20', printf('%x', 1099511627776 + o_orderkey * 37 + o_custkey), '181') WHEN 2 THEN concat(o_custkey, 'e1') WHEN 3 THEN 'NaN' WHEN 4 THEN 'Infinity' WHEN 5 THEN concat(o_custkey, 'd') "
    "WHEN 6 THEN concat('-', o_custkey) WHEN 7 THEN '' ELSE concat('.', o_custkey) END"
)


@query(
    "scalar_pack_orders",
    # The value of a long literal lies between doubles: a whole number of 62 bits, rounded once by the cast.
    f"SELECT o_orderkey, t AS spelled, CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_custkey AS DOUBLE) "
    "WHEN o_orderkey % 10 = 9 THEN CAST(2305843009213693952 + "
    "CAST(1099511627776 + o_orderkey * 37 + o_custkey AS BIGINT) * 4096 + 385 AS DOUBLE) "
    "WHEN o_orderkey % 10 IN (3, 4, 5, 7) THEN NULL ELSE CAST(trim(t) AS DOUBLE) END AS number, "
    "concat('brand#', lpad(CAST(length(n) AS VARCHAR), 10, '0'), n, 'x') AS natural "
    f"FROM (SELECT *, {_NUMERIC_TEXT} AS t, CASE WHEN o_custkey = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS n FROM orders) o",
)
def scalar_pack_orders(spark, sf):
    orders = table(spark, sf, "orders")
    spelled = F.expr(
        _NUMERIC_TEXT.replace("printf('%x', o_custkey)", "lower(hex(o_custkey))").replace(
            "printf('%x', 1099511627776 + o_orderkey * 37 + o_custkey)",
            "lower(hex(1099511627776 + o_orderkey * 37 + o_custkey))",
        )
    )
    return orders.withColumn("spelled", spelled).select(
        "o_orderkey",
        "spelled",
        number_or_null(F.col("spelled")).alias("number"),
        natural_key(F.concat(F.lit("Brand#00"), F.col("o_custkey").cast("string"), F.lit("x"))).alias("natural"),
    )


@query(
    "hex_dump",
    "WITH d AS (SELECT doc_id, lower(hex(encode(text))) AS h FROM documents), "
    "n AS (SELECT doc_id, h, length(h) // 2 AS size, least(length(h) // 2, 256) AS shown FROM d) "
    "SELECT doc_id, concat(array_to_string(list_transform(range(0, CAST(ceil(shown / 16.0) AS BIGINT)), lambda i: concat("
    "lpad(lower(to_hex(i * 16)), 8, '0'), '  ', rpad(rtrim(regexp_replace(substr(h, i * 32 + 1, least(32, shown * 2 - i * 32)), "
    "'(..)', '\\1 ', 'g')), 47, ' '), '  ', array_to_string(list_transform(range(0, least(16, shown - i * 16)), lambda j: CASE WHEN "
    "substr(h, i * 32 + j * 2 + 1, 2) BETWEEN '20' AND '7e' THEN decode(unhex(substr(h, i * 32 + j * 2 + 1, 2))) ELSE '.' END), ''))), "
    "chr(10)), CASE WHEN size > 256 THEN concat(chr(10), '... (', size - 256, ' more bytes)') ELSE '' END) AS dump FROM n",
)
def hex_dump(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fmt.hex_dump(F.encode("text", "UTF-8"), 256).alias("dump"))


# -------------------------------------------------------------- classification

_TEXTS_SQL = (
    "(SELECT 'pages' AS origin, page_id AS id, html AS body FROM pages UNION ALL SELECT 'documents', doc_id, text FROM documents "
    "UNION ALL SELECT 'events', event_id, CASE WHEN event_id % 5 = 0 THEN concat(props, chr(10), props) ELSE props END FROM events)"
)


def _texts(spark, sf):
    pages = table(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    docs = table(spark, sf, "documents").select(F.lit("documents"), "doc_id", "text")
    twice = F.when(F.col("event_id") % 5 == 0, F.concat_ws("\n", "props", "props")).otherwise(F.col("props"))
    events = table(spark, sf, "events").select(F.lit("events"), "event_id", twice)
    return pages.union(docs).union(events)


_WS = "'" + WHITESPACE + "'"
_ANY_LINE = "len(list_filter(top30, lambda x: regexp_matches(x, '{p}'))) > 0"
_SNIFFED = " OR ".join(
    f"len(list_filter(top10, lambda x: contains(regexp_replace(x, '\"[^\"]*(\"|$)', '\"', 'g'), '{c}'))) > 0" for c in (",", ";", "\t", "|")
)
_HTML = "(?is)^\\s*(?:<!--.*?-->\\s*)*(<!doctype\\s+html[\\s>\\[]|<html[\\s>])"


@query(
    "text_kind",
    "WITH t AS (SELECT *, list_filter(list_transform(string_split_regex(body, '\\r?\\n'), lambda x: trim(x, " + _WS + ")), lambda x: x <> '') "
    "AS lines FROM " + _TEXTS_SQL + " s), u AS (SELECT *, trim(body, " + _WS + ") AS b, lines[1:10] AS top10, lines[1:20] AS top20, "
    "lines[1:30] AS top30, list_filter(lines, lambda x: NOT starts_with(x, '%%'))[1] AS code FROM t) "
    "SELECT origin, id, CASE WHEN len(lines) = 0 THEN NULL "
    "WHEN regexp_matches(b, '^[{\\[]') AND len(lines) >= 2 AND len(list_filter(top10, lambda x: NOT (json_valid(x) AND "
    "regexp_matches(x, '^[{\\[]')))) = 0 THEN 'jsonl' WHEN regexp_matches(b, '^[{\\[]') AND json_valid(b) THEN 'json' "
    "WHEN regexp_matches(body, '" + _HTML + "') THEN 'html' "
    "WHEN len(list_filter(top20, lambda x: NOT regexp_matches(x, '^\\[\\[?[A-Za-z0-9_.\\-\"''\\s]+\\]?\\]$') AND "
    "regexp_matches(x, '^[A-Za-z0-9_.\\-\"'']+\\s*='))) >= 3 THEN 'toml' "
    "WHEN " + _ANY_LINE.format(p="^\\\\documentclass\\s*(\\[|\\{)") + " THEN 'latex' "
    "WHEN coalesce(regexp_matches(code, '^(" + "|".join(classify.MERMAID_WORDS) + ")\\b'), false) THEN 'mermaid' "
    "WHEN " + " OR ".join(_ANY_LINE.format(p=p) for p in (classify.PLANTUML_START, *classify.PLANTUML_LINES)) + " THEN 'plantuml' "
    "WHEN " + _SNIFFED + " THEN 'csv' END AS kind FROM u",
)
def text_kind(spark, sf):
    allow_duplicate_keys(spark)
    return _texts(spark, sf).select("origin", "id", classify.text_kind(F.col("body")).alias("kind"))


# One JSON or XML dialect per remainder of the event key.
_DIALECTS = [
    ("har", '{"log": {"version": "1.2", "entries": [@]}}'),
    ("notebook", '{"cells": [], "nbformat": 4, "metadata": @}'),
    ("sarif", '{"version": "2.1.0", "runs": [@]}'),
    ("sbom", '{"bomFormat": "CycloneDX", "components": [@]}'),
    ("trace", '{"traceEvents": [@]}'),
    ("geojson", '{"type": "FeatureCollection", "features": [@]}'),
    ("geojson", '{"type": "Feature", "geometry": null, "properties": @}'),
    ("geojson", '{"type": "Point", "coordinates": [1, 2], "x": @}'),
    ("json", '{"meta": {"log": {"entries": [@]}}}'),
    ("json", '{"traceEvents": @}'),
    ("json", "[@]"),
    ("gps", '<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"/>'),
    ("gps", '<!-- k --><k:kml xmlns:k="http://www.opengis.net/kml/2.2"></k:kml>'),
    ("xml", '<kml xmlns="http://www.opengis.net/kml/2.3"></kml>'),
    ("junit", "<testsuites><testsuite/></testsuites>"),
    ("drawio", '<mxfile host="h"><diagram/></mxfile>'),
    ("openvino", '<net name="m" version="11"><layers></layers></net>'),
    ("xml", '<net name="m"><layers></layers></net>'),
]


@query(
    "json_dialect",
    "SELECT event_id, (["
    + ", ".join(f"'{k}'" for k, _ in _DIALECTS)
    + f"])[event_id % {len(_DIALECTS)} + 1] AS dialect FROM events",
)
def json_dialect(spark, sf):
    allow_duplicate_keys(spark)
    events = table(spark, sf, "events")

    def body(pattern: str):
        parts = [F.lit(p) for p in pattern.split("@")]
        return parts[0] if len(parts) == 1 else F.concat(parts[0], F.col("props"), parts[1])

    texts = F.array(*[body(p) for _, p in _DIALECTS])
    text = F.get(texts, (F.col("event_id") % len(_DIALECTS)).cast("int"))
    return events.select("event_id", text.alias("body")).select("event_id", classify.document_dialect(F.col("body")).alias("dialect"))
