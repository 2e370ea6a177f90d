"""Documents derived from the tables, so that document queries grow with them.

Where a document gathers several rows it takes a fixed run of keys (one
hundred events, twenty parts), never all rows of a value, so no document
depends on how the values are distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.plans.registry import table

EVENTS_PER_DOC = 100
PARTS_PER_DOC = 20


def joined(df: DataFrame, doc: Column, order: str, text: Column, glue: str, name: str = "body") -> DataFrame:
    """One text per document: its rows' texts in key order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), text.alias("t"))))
    return df.groupBy(doc.cast("long").alias("doc_id")).agg(
        F.array_join(F.transform(pairs, lambda p: p["t"]), glue).alias(name)
    )


def order_docs(spark: SparkSession, sf: str) -> DataFrame:
    """``(o_orderkey, body)``: a nested JSON document per order."""
    orders = table(spark, sf, "orders")
    tags = F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    body = F.struct(
        F.array(
            F.struct(F.col("o_orderkey").alias("code"), (F.col("o_orderkey") % 7).alias("qty")),
            F.struct((F.col("o_custkey") % 5).alias("code"), F.col("o_totalprice").alias("qty")),
        ).alias("amounts"),
        F.struct(F.col("o_custkey").alias("key"), tags.alias("tags")).alias("customer"),
        (F.col("o_orderkey") % 2 == 0).alias("even"),
        F.lit(None).cast("string").alias("note"),
    )
    return orders.select("o_orderkey", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


# The same documents in the comparison SQL.
ORDER_DOCS_SQL = (
    "(SELECT o_orderkey, to_json(struct_pack(amounts := [struct_pack(code := o_orderkey, qty := CAST(o_orderkey % 7 AS DOUBLE)), "
    "struct_pack(code := o_custkey % 5, qty := o_totalprice)], customer := struct_pack(key := o_custkey, "
    "tags := struct_pack(priority := o_orderpriority, status := o_orderstatus)), even := o_orderkey % 2 = 0, note := NULL)) "
    "AS body FROM orders)"
)


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events with one JSON line each: every 13th is cut off, every 17th blank."""
    k = F.col("event_id")
    line = (
        F.when(k % 17 == 0, "  ")
        .when(k % 13 == 0, F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "props": ')))
        .otherwise(F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "props": '), F.col("props"), F.lit("}")))
    )
    return table(spark, sf, "events").select("event_id", line.alias("raw"))


EVENT_LINES_SQL = (
    "(SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '  ' WHEN event_id % 13 = 0 THEN "
    "concat('{\"id\": ', event_id, ', \"props\": ') ELSE concat('{\"id\": ', event_id, ', \"props\": ', props, '}') END AS raw "
    "FROM events)"
)


def line_docs(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, body)``: line-delimited JSON documents of a hundred lines."""
    doc = F.floor(F.col("event_id") / EVENTS_PER_DOC)
    return joined(event_lines(spark, sf), doc, "event_id", F.col("raw"), "\n")


LINE_DOCS_SQL = (
    "(SELECT event_id // 100 AS doc_id, event_id, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) AS line_no, "
    f"raw FROM {EVENT_LINES_SQL} e)"
)
