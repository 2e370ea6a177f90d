"""JSON text as VARIANT: strict parsing, node kinds and scalar text."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.binding import let
from fieldglass.functions.cells import number_text, trimmed


def allow_duplicate_keys(spark: SparkSession) -> None:
    """The last of several equal keys wins, as in a script engine."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_json(text: Column) -> Column:
    """Parse one JSON value that fills the whole text, else null.

    ``try_parse_json`` stops after the first value and ignores what follows.
    The text is therefore parsed as the first item of an array whose second
    item is a hash of the text: only a single complete value leaves an array
    of exactly those two.
    """

    def checked(t: Column) -> Column:
        mark = F.xxhash64(t).cast("string")
        pair = F.try_parse_json(F.concat(F.lit("["), t, F.lit(","), mark, F.lit("]"))).try_cast("array<variant>")
        return let(
            pair,
            lambda p: F.when((F.size(p) == 2) & (F.to_json(F.get(p, F.lit(1))) == mark), F.get(p, F.lit(0))),
        )

    return let(text, checked)


def line_kind(text: Column) -> Column:
    """``empty``, ``valid`` or ``invalid`` for one line of line-delimited JSON."""
    t = trimmed(text)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "empty")
        .when(strict_json(t).isNotNull(), "valid")
        .otherwise("invalid")
    )


def kind_of_schema(schema: Column) -> Column:
    """Node kind from ``schema_of_variant`` text."""
    return (
        F.when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .when(schema.isNotNull(), "number")
    )


def json_kind(value: Column) -> Column:
    """object, array, string, number, boolean or null."""
    return let(F.schema_of_variant(value), kind_of_schema)


def scalar_text(value: Column, kind: Column) -> Column:
    """A scalar as text; strings keep their quotes; null for containers."""
    text = F.to_json(value)
    number = F.when(text.rlike(r"^-?[0-9]{1,15}$"), text).otherwise(number_text(value.try_cast("double")))
    return F.when(kind.isin("string", "boolean", "null"), text).when(kind == "number", number)


def members(value: Column) -> Column:
    """Children of a container as ``array<struct<key, value, within>>``; null for scalars.

    Objects list their keys in byte order, arrays their positions from zero;
    ``within`` names the container's kind.
    """
    entries = F.transform(
        F.map_entries(value.try_cast("map<string,variant>")),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit("object").alias("within")),
    )
    items = F.transform(
        value.try_cast("array<variant>"),
        lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value"), F.lit("array").alias("within")),
    )
    return F.coalesce(entries, items)


def nesting_depth(text: Column) -> Column:
    """How many containers enclose the innermost value (0 for a scalar)."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(marks, start, step, lambda acc: acc["top"])
