"""Nested documents: node tables, search, canonical text and conversions.

A document is read token by token inside its own row (``functions.json_walk``), so a
node table is one scan without any shuffle, with one plan for documents of any depth.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.binding import let
from fieldglass.functions.cells import number_text
from fieldglass.functions.formatting import escape_xml, quote_csv
from fieldglass.functions.json_text import json_kind, nesting_depth, strict_json
from fieldglass.functions.json_walk import framed_scalars, token_kind, value_rows, walk, with_records


def max_depth(df: DataFrame, text: Column) -> int:
    """The deepest nesting among the valid documents: one scan, one number."""
    return df.agg(F.max(F.when(strict_json(text).isNotNull(), nesting_depth(text))).alias("d")).first()["d"] or 0


def _spelled(token: Column) -> Column:
    """What a string's token spells; only escapes need the parser."""
    return F.when(F.contains(token, F.lit("\\")), F.try_parse_json(token).try_cast("string")).otherwise(
        F.substring(token, F.lit(2), F.length(token) - 2)
    )


def _scalar(token: Column, kind: Column) -> Column:
    """The text of a scalar's token; strings keep their quotes; null for containers."""
    number = F.when(token == "-0", "0").when(token.rlike(r"^-?[0-9]{1,15}$"), token).otherwise(number_text(token.try_cast("double")))
    string = F.when(F.contains(token, F.lit("\\")), F.to_json(F.try_parse_json(token))).otherwise(token)
    return F.when(kind == "string", string).when(kind == "number", number).when(kind.isin("boolean", "null"), token)


def node_table(df: DataFrame, keys: list[str], text: Column, depth: int | None = None) -> DataFrame:
    """One row per node: path, parent, key, kind, scalar text, depth, place.

    Nodes come as the document is written; ``place`` sorts the nodes of a document
    depth first. With an explicit ``depth`` deeper nodes are left out and the containers cut
    there are flagged ``truncated``.
    """
    own = [f"_own{i}" for i in range(len(keys))]
    given = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, own, strict=True)], text.alias("_body"))
    node = value_rows(given, "_body", depth).withColumn("kind", token_kind(F.col("token")))
    return node.select(
        *[F.col(n).alias(k) for k, n in zip(keys, own, strict=True)],
        "path",
        "parent_path",
        "key",
        "kind",
        _scalar(F.col("token"), F.col("kind")).alias("primitive"),
        "depth",
        "ordinal",
        "place",
        (F.lit(False) if depth is None else F.col("filled") & (F.col("depth") == depth)).alias("truncated"),
    )


def search_nodes(nodes: DataFrame, *queries: str) -> DataFrame:
    """Nodes whose key or scalar text holds one of the trimmed queries, in one pass; none when all are blank."""
    key, primitive = F.lower("key"), F.lower("primitive")
    held = F.lit(False)
    for needle in (F.lit(q.strip().lower()) for q in queries if q.strip()):
        held = held | F.contains(key, needle) | F.coalesce(F.contains(primitive, needle), F.lit(False))
    return nodes.where(held)


def match_ancestors(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct containers above the matches; a path spells its ancestors."""
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    below_root = matches.where("path <> ''")
    return below_root.select(*keys, F.explode(above).alias("path")).distinct()


def key_union(df: DataFrame, text: Column) -> DataFrame:
    """Every key of the documents' top-level objects, with how many hold it."""
    keys = F.map_keys(strict_json(text).try_cast("map<string,variant>"))
    return df.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("documents"))


def canonical_json(text: Column) -> Column:
    """Compact text with object keys in byte order at every level."""
    return F.to_json(strict_json(text))


def minified_json(text: Column) -> Column:
    """The document without whitespace between tokens; order and spelling kept."""
    bare = F.regexp_replace(text, r'(?s)("(?:[^"\\]|\\.)*+")|[ \t\r\n]+', "$1")
    return F.when(strict_json(text).isNotNull(), bare)


def _assembled(df: DataFrame, keys: list[str], text: Column, piece, name: str) -> DataFrame:
    """Build one text per document from ``piece(record)``, one after another."""
    read = with_records(df.select(*keys, text.alias("_body")), "_body", "_records")
    parts = F.transform("_records", lambda r: let(token_kind(r["token"]), lambda kind: piece(r, kind)))
    return read.select(*keys, F.array_join(parts, "").alias(name))


def _quoted(text: Column) -> Column:
    json = F.to_json(F.array(text))
    return F.substring(json, F.lit(2), F.length(json) - 2)


def pretty_json(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Two-space indented text, keys as written."""

    def piece(r: Column, kind: Column) -> Column:
        line = F.concat(F.lit("\n"), F.repeat(F.lit("  "), r["depth"]))
        label = F.when(r["parent_kind"] == "object", F.concat(_quoted(r["key"]), F.lit(": "))).otherwise("")
        before = F.when(r["depth"] == 0, "").otherwise(F.concat(F.when(r["ordinal"] > 0, ",").otherwise(""), line))
        return F.when(r["closes"], F.concat(F.when(r["filled"], line).otherwise(""), r["token"])).otherwise(
            F.concat(before, label, F.coalesce(_scalar(r["token"], kind), r["token"]))
        )

    return _assembled(df, keys, text, piece, "pretty")


def json_to_yaml(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Block-style YAML, strings in JSON quotes."""

    def piece(r: Column, kind: Column) -> Column:
        first = (r["depth"] == 1) & (r["ordinal"] == 0)
        line = F.concat(F.when(first, "").otherwise("\n"), F.repeat(F.lit("  "), r["depth"] - 1))
        label = F.when(r["parent_kind"] == "array", F.lit("- ")).otherwise(F.concat(r["key"], F.lit(": ")))
        return (
            F.when(r["closes"], F.when(r["filled"] | (r["depth"] == 0), "").otherwise("\n"))
            .when(r["depth"] == 0, F.coalesce(_scalar(r["token"], kind), F.lit("")))
            .otherwise(F.concat(line, label, F.coalesce(_scalar(r["token"], kind), F.lit(""))))
        )

    return _assembled(df, keys, text, piece, "yaml")


def json_to_xml(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Elements named by key (``item`` inside arrays), ``root`` outermost.

    Tags depend on a document's shape alone, so they are spelled once for all documents
    of a shape; the scalars that need a conversion get it here.
    """

    def tags(r: list, container: bool) -> tuple[str, str]:
        closes, path, _, key, parent_kind, depth = r[:6]
        if depth == 0:
            name = "root"
        elif parent_kind == "array":
            name = "item"
        else:
            step = path.rsplit("/", 1)[-1].replace("~1", "/").replace("~0", "~") if key is None else key
            name = re.sub("[^A-Za-z0-9_.-]", "_", step)
        return ("" if closes else f"<{name}>", f"</{name}>" if closes or not container else "")

    def spelled(token: Column) -> Column:
        kind = token_kind(token)
        return escape_xml(F.when(kind == "string", _spelled(token)).otherwise(_scalar(token, kind)))

    read = framed_scalars(df.select(*keys, text.alias("_body")), "_body", tags)
    last = F.element_at("_before", -1)
    between = F.zip_with("_before", F.transform("_scalars", spelled), lambda b, s: F.concat(b, F.coalesce(s, F.lit(""))))
    return read.select(*keys, F.when(F.size("_scalars") == 0, last).otherwise(F.array_join(between, "")).alias("xml"))


def json_to_csv(text: Column) -> Column:
    """A document's objects as CSV, every cell quoted, keys in first-seen order.

    Items that are not objects are dropped; a nested cell is written as JSON.
    """
    # A VARIANT sorts its keys; the written order is in the tokens.
    depth = F.when(F.ltrim(text).startswith("["), 2).otherwise(1)
    own = lambda r: ~r["closes"] & (r["depth"] == depth) & (r["parent_kind"] == "object")
    heads = F.array_distinct(F.transform(F.filter(walk(text), own), lambda r: r["key"]))
    return let(F.struct(strict_json(text).alias("doc"), heads.alias("heads")), lambda both: _csv_of(both["doc"], both["heads"]))


def _csv_of(doc: Column, heads: Column) -> Column:
    items = F.coalesce(doc.try_cast("array<variant>"), F.array(doc))
    objects = F.filter(F.transform(items, lambda v: v.try_cast("map<string,variant>")), lambda m: m.isNotNull())

    def cell(v: Column) -> Column:
        return let(
            json_kind(v),
            lambda kind: F.when(v.isNull() | (kind == "null"), "")
            .when(kind == "string", v.try_cast("string"))
            .when(kind == "number", number_text(v.try_cast("double")))
            .otherwise(F.to_json(v)),
        )

    def line(row: Column) -> Column:
        return F.array_join(F.transform(heads, lambda k: quote_csv(cell(F.element_at(row, k)))), ",")

    first = F.array(F.array_join(F.transform(heads, quote_csv), ","))
    return F.when(doc.isNotNull(), F.array_join(F.concat(first, F.transform(objects, line)), "\n"))


def line_and_column(text: Column, offset: Column) -> Column:
    """1-based ``(line, col)`` of a 0-based offset; ``(1, 1)`` outside the text."""
    before = F.substring(text, F.lit(1), offset)
    lines = F.split(before, r"\r\n|\r|\n")
    line = F.size(lines)
    column = F.length(F.element_at(lines, -1)) + 1
    inside = (offset >= 0) & (offset <= F.length(text))
    return F.struct(
        F.when(inside, line).otherwise(1).alias("line"), F.when(inside, column).otherwise(1).alias("col")
    )


def json_escape(text: Column) -> Column:
    return _quoted(text)


def json_unescape(text: Column) -> Column:
    return strict_json(text).try_cast("string")
