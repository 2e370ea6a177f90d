"""Profiles, searches, orders, pages, joins and exports of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.cells import WHITESPACE
from fieldglass.operators import integrity, ordering, profile, search, tensors
from fieldglass.plans.registry import TABLES, query, table
from fieldglass.sinks import export
from fieldglass.sources import columnar

# Column types of the tables, for the generated comparison SQL.
COLUMNS = {
    "region": "r_regionkey:n r_name:s",
    "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:d",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:d",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:d l_extendedprice:d l_discount:d "
    "l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:n ts:t user_id:n event_type:s value:d props:s",
    "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "embeddings": "vec_id:n embedding:x label:n",
    "pages": "page_id:n url:s html:s",
    "benchmark": "item_id:n text:s",
    "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:s text:s",
}

_WS = "'" + WHITESPACE + "'"
DEC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def sql_trim(c: str) -> str:
    return f"trim({c}, {_WS})"


def sql_number(c: str) -> str:
    t = sql_trim(c)
    return f"CASE WHEN regexp_matches({t}, '{DEC}') THEN try_cast({t} AS DOUBLE) END"


def sql_text(c: str, kind: str, null_text: str | None) -> str:
    """The searchable text of a column in the comparison SQL."""
    if kind == "d":
        out = rf"regexp_replace(CAST({c} AS VARCHAR), '\.0$', '')"
    elif kind == "t":
        out = f"strftime({c}, '\"%Y-%m-%dT%H:%M:%S.%gZ\"')"
    else:
        out = f"CAST({c} AS VARCHAR)"
    return out if null_text is None else f"coalesce({out}, '{null_text}')"


def columns_of(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[name].split()]


def profile_sql(source: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        if kind == "s":
            filled, number = f"coalesce({sql_trim(c)}, '') <> ''", sql_number(c)
        elif kind in "nd":
            filled, number = f"{c} IS NOT NULL", f"CAST({c} AS DOUBLE)"
        else:
            filled, number = f"{c} IS NOT NULL", "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS column_index, '{c}' AS column_name, count(*) AS total, "
            f"count(*) FILTER (WHERE {filled}) AS filled, count({number}) AS numbers, "
            f"sum({number}) AS s, min({number}) AS lo, max({number}) AS hi FROM {source}"
        )
    return (
        "SELECT column_index, column_name, total, filled, total - filled AS blank, "
        "round(CASE WHEN total = 0 THEN 0 ELSE (total - filled) / total END, 6) AS blank_share, "
        "filled > 0 AND filled = numbers AS is_numeric, "
        "CASE WHEN filled > 0 AND filled = numbers THEN round(s / numbers, 4) END AS mean, "
        "CASE WHEN filled > 0 AND filled = numbers THEN lo END AS min, "
        "CASE WHEN filled > 0 AND filled = numbers THEN hi END AS max FROM ("
        + " UNION ALL ".join(parts)
        + ") p"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("blank_share", F.round("blank_share", 6)).withColumn("mean", F.round("mean", 4))


def _register_profiles() -> None:
    for name in TABLES:

        def run(spark: SparkSession, sf: str, name: str = name) -> DataFrame:
            return _rounded(profile.column_profile(table(spark, sf, name)))

        key = "column_profile" if name == "lineitem" else f"column_profile_{name}"
        query(key, profile_sql(name, columns_of(name)))(run)


_register_profiles()

# Orders with gaps: every 7th key has nulls, every 11th blanks, and the
# customer key is written in several numeric spellings.
BLANK_ORDERS = (
    "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '   ' "
    "ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ' ' "
    "WHEN o_orderkey % 5 = 0 THEN concat('  ', CAST(o_custkey AS VARCHAR(20)), ' ') "
    "WHEN o_orderkey % 3 = 0 THEN concat(CAST(o_custkey AS VARCHAR(20)), 'e1') "
    "ELSE concat(CAST(o_custkey AS VARCHAR(20)), '.50') END AS amount, "
    "CASE WHEN o_orderkey % 13 = 0 THEN 'abc' ELSE CAST(o_custkey AS VARCHAR(20)) END AS mixed FROM orders)"
)


def blank_orders(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(f"SELECT * FROM {BLANK_ORDERS} b")


_BLANK_COLUMNS = [("o_orderkey", "n"), ("status", "s"), ("amount", "s"), ("mixed", "s")]


@query("column_profile_blanks", profile_sql(f"{BLANK_ORDERS} b", _BLANK_COLUMNS))
def column_profile_blanks(spark, sf):
    return _rounded(profile.column_profile(blank_orders(spark, sf)))


def types_sql(source: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        if kind == "s":
            t = sql_trim(c)
            filled, number = f"coalesce({t}, '') <> ''", sql_number(c)
            dated = f"CASE WHEN regexp_matches({t}, '[-/:T]') THEN try_cast({t} AS TIMESTAMP) END"
        elif kind == "t":
            filled, number, dated = f"{c} IS NOT NULL", "NULL", c
        elif kind in "nd":
            filled, number, dated = f"{c} IS NOT NULL", c, "NULL"
        else:
            filled, number, dated = f"{c} IS NOT NULL", "NULL", "NULL"
        parts.append(
            f"SELECT {i} AS column_index, '{c}' AS column_name, count(*) FILTER (WHERE {filled}) AS filled, "
            f"count({number}) AS n, count({dated}) AS d FROM {source}"
        )
    return (
        "SELECT column_index, column_name, filled, CASE WHEN filled = 0 THEN 'text' WHEN filled = n THEN 'number' "
        "WHEN filled = d THEN 'date' ELSE 'text' END AS kind FROM (" + " UNION ALL ".join(parts) + ") p"
    )


def _register_types() -> None:
    for name in ("orders", "lineitem", "events", "documents"):

        def run(spark: SparkSession, sf: str, name: str = name) -> DataFrame:
            return profile.column_types(table(spark, sf, name))

        query(f"column_types_{name}", types_sql(name, columns_of(name)))(run)


_register_types()


@query("column_types_blanks", types_sql(f"{BLANK_ORDERS} b", _BLANK_COLUMNS))
def column_types_blanks(spark, sf):
    return profile.column_types(blank_orders(spark, sf))


DATED_ORDERS = (
    "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE "
    "{day} END AS day, CASE WHEN o_orderkey % 2 = 0 THEN {day} ELSE o_orderstatus END AS part_dated FROM orders)"
)


@query(
    "column_types_date_text",
    types_sql(
        DATED_ORDERS.format(day="strftime(o_orderdate, '%Y-%m-%d')") + " b",
        [("o_orderkey", "n"), ("day", "s"), ("part_dated", "s")],
    ),
)
def column_types_date_text(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return profile.column_types(
        spark.sql("SELECT * FROM " + DATED_ORDERS.format(day="date_format(o_orderdate, 'yyyy-MM-dd')") + " b")
    )


# ------------------------------------------------------------------- search


def search_sql(source: str, columns: list[tuple[str, str]], term: str, null_text: str | None) -> str:
    tests = [f"contains(lower({sql_text(c, k, null_text or '')}), '{term.lower()}')" for c, k in columns]
    return " OR ".join(tests)


@query("search_rows", f"SELECT * FROM lineitem WHERE {search_sql('lineitem', columns_of('lineitem'), '999', 'null')}")
def search_rows(spark, sf):
    return search.search_rows(table(spark, sf, "lineitem"), "999")


@query("search_rows_text", f"SELECT * FROM customer WHERE {search_sql('customer', columns_of('customer'), 'BuildING', 'null')}")
def search_rows_text(spark, sf):
    return search.search_rows(table(spark, sf, "customer"), "BuildING")


_LABELLED = [("doc_id", "n"), ("lang", "s"), ("quality", "n"), ("toxic", "n")]
_LABELLED_SQL = (
    "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) j"
)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")


@query("search_rows_nulls", f"SELECT * FROM {_LABELLED_SQL} WHERE {search_sql('j', _LABELLED, 'null', 'null')}")
def search_rows_nulls(spark, sf):
    return search.search_rows(_labelled(spark, sf), "null")


@query(
    "search_counts",
    "SELECT count(*) FILTER (WHERE "
    + search_sql("customer", columns_of("customer"), "machinery", "")
    + ") AS visible, count(*) AS total FROM customer",
)
def search_counts(spark, sf):
    return search.search_counts(table(spark, sf, "customer"), "machinery")


@query(
    "search_counts_documents",
    "SELECT count(*) FILTER (WHERE "
    + search_sql("documents", columns_of("documents"), "http", "")
    + ") AS visible, count(*) AS total FROM documents",
)
def search_counts_documents(spark, sf):
    return search.search_counts(table(spark, sf, "documents"), "http")


@query(
    "raw_payload",
    "SELECT 'supplier' AS name, to_json([CAST(s_suppkey AS VARCHAR), s_name, "
    + sql_text("s_acctbal", "d", None)
    + "]) AS cells, 3 AS total_columns, (SELECT count(*) FROM supplier) AS total_rows FROM supplier",
)
def raw_payload(spark, sf):
    return profile.raw_payload(table(spark, sf, "supplier"), "supplier", ["s_suppkey", "s_name", "s_acctbal"])


# ------------------------------------------------------------- aggregations


@query("top_kinds_events", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def top_kinds_events(spark, sf):
    return profile.top_kinds(table(spark, sf, "events"), F.col("event_type"))


@query(
    "top_kinds_parts",
    "SELECT kind, n FROM (SELECT p_type AS kind, count(*) AS n FROM part GROUP BY 1) k ORDER BY n DESC, kind LIMIT 3",
)
def top_kinds_parts(spark, sf):
    return profile.top_kinds(table(spark, sf, "part"), F.col("p_type"), 3)


@query(
    "kpi_row",
    "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, "
    "count(*) FILTER (WHERE o_totalprice > 200000) AS large, coalesce(max(o_totalprice), 0) AS max_price FROM orders",
)
def kpi_row(spark, sf):
    return profile.kpi_row(
        table(spark, sf, "orders"),
        {"finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 200000},
        {"max_price": F.col("o_totalprice")},
    )


_MARKERS = ["the", "ou", "##HD", "er"]


@query(
    "marker_counts",
    "SELECT doc_id, marker, n FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{m}' AS marker, CAST((length(text) - length(replace(text, '{m}', ''))) / {len(m)} AS BIGINT) AS n "
        "FROM documents"
        for m in _MARKERS
    )
    + ") m WHERE n > 0",
)
def marker_counts(spark, sf):
    return profile.marker_counts(table(spark, sf, "documents"), F.col("text"), _MARKERS, ["doc_id"])


@query(
    "tensor_summary",
    "SELECT 'float' AS dtype, len(embedding) AS shape, count(*) AS arrays, CAST(sum(len(embedding)) AS BIGINT) AS elements, "
    "CAST(sum(len(embedding)) * 4 AS BIGINT) AS bytes FROM embeddings GROUP BY 2",
)
def tensor_summary(spark, sf):
    return tensors.tensor_summary(table(spark, sf, "embeddings"), "embedding")


@query(
    "tensor_slice",
    "SELECT vec_id, element, embedding[element + 1] AS value FROM embeddings, range(8, 16) r(element)",
)
def tensor_slice(spark, sf):
    out = tensors.tensor_slice(table(spark, sf, "embeddings"), ["vec_id"], "embedding", 8, 8)
    return out.withColumn("element", F.col("element").cast("long"))


# ---------------------------------------------------------------- ordering


def _typed(spark, df: DataFrame, column: str, direction: str, ties: list[str]) -> DataFrame:
    keys = ordering.typed_sort_keys(df, column, direction, ties)
    return ordering.with_positions(df, keys)


def position_sql(source: str, columns: str, order: str) -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM {source}"


def _register_sorts() -> None:
    numbers = "(amount_number IS NULL), amount_number {d}, o_orderkey"
    amounts = f"(SELECT o_orderkey, amount, {sql_number('amount')} AS amount_number FROM {BLANK_ORDERS} b) x"
    for d in ("asc", "desc"):

        def number(spark, sf, d=d):
            return _typed(spark, table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", d, ["c_custkey"])

        query(f"typed_sort_number_{d}", position_sql("customer", "c_custkey, c_acctbal", f"c_acctbal {d}, c_custkey"))(number)

        def blanks(spark, sf, d=d):
            return _typed(spark, blank_orders(spark, sf).select("o_orderkey", "amount"), "amount", d, ["o_orderkey"])

        query(
            f"typed_sort_blanks_{d}", position_sql(amounts, "o_orderkey, amount", numbers.format(d=d))
        )(blanks)

        def date(spark, sf, d=d):
            return _typed(spark, table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", d, ["o_orderkey"])

        query(f"typed_sort_date_{d}", position_sql("orders", "o_orderkey, o_orderdate", f"o_orderdate {d}, o_orderkey"))(date)

        def text(spark, sf, d=d):
            return _typed(spark, table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", d, ["p_partkey"])

        query(
            f"typed_sort_text_{d}",
            position_sql("part", "p_partkey, p_brand", f"CAST(substr(p_brand, 7) AS INTEGER) {d}, p_partkey"),
        )(text)


_register_sorts()

_HOT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "typed_sort_hot_values",
    position_sql("lineitem", "l_returnflag, " + ", ".join(_HOT), "l_returnflag DESC, " + ", ".join(_HOT)),
)
def typed_sort_hot_values(spark, sf):
    """Three flags hold all rows: the tie-breakers split them over the ranges."""
    df = table(spark, sf, "lineitem").select("l_returnflag", *_HOT)
    return _typed(spark, df, "l_returnflag", "desc", _HOT)


_PAGE_COLUMNS = "o_orderkey, o_totalprice"


def _order_keys() -> list[ordering.SortKey]:
    return [ordering.SortKey(F.col("o_totalprice"), False), ordering.SortKey(F.col("o_orderkey"))]


def page_sql(page: str, where: str = "true", size: int = 200) -> str:
    return (
        f"WITH m AS (SELECT {_PAGE_COLUMNS} FROM orders WHERE {where}), "
        f"c AS (SELECT greatest(1, CAST(ceil(count(*) / {size}.0) AS BIGINT)) AS pages FROM m), "
        f"n AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rn FROM m) "
        f"SELECT {_PAGE_COLUMNS} FROM n, c WHERE rn >= (least(greatest({page}, 1), pages) - 1) * {size} "
        f"AND rn < least(greatest({page}, 1), pages) * {size}"
    )


def _page(spark, sf, page: int, term: str = "") -> DataFrame:
    df = table(spark, sf, "orders")
    kept = search.search_rows(df, term, "").select("o_orderkey", "o_totalprice")
    return ordering.page_slice(kept, _order_keys(), page)


@query("page_slice", page_sql("1"))
def page_slice(spark, sf):
    return _page(spark, sf, 1)


@query("page_slice_last", page_sql("1000000"))
def page_slice_last(spark, sf):
    return _page(spark, sf, 1000000)


@query("page_slice_search", page_sql("2", search_sql("orders", columns_of("orders"), "urgent", "")))
def page_slice_search(spark, sf):
    return _page(spark, sf, 2, "URGENT")


@query("page_slice_deep", page_sql("11"))
def page_slice_deep(spark, sf):
    """A page of an order cut into many parts, as that of a large table is."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordering.page_slice(df, _order_keys(), 11, part_rows=1000)


@query(
    "load_batches",
    "WITH c AS (SELECT count(*) AS total FROM lineitem), b AS (SELECT unnest(range(CAST(ceil(total / 10000.0) AS BIGINT))) "
    "AS batch_no, total FROM c) SELECT batch_no, least(10000, total - batch_no * 10000) AS rows, "
    "least(total, (batch_no + 1) * 10000) AS loaded, total, round(least(total, (batch_no + 1) * 10000) / total, 6) "
    "AS loaded_share FROM b",
)
def load_batches(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    slim = table(spark, sf, "lineitem").select(*keys)
    placed = ordering.with_positions(slim, [ordering.SortKey(F.col(k)) for k in keys])
    return ordering.load_batches(placed).withColumn("loaded_share", F.round("loaded_share", 6))


# --------------------------------------------------------------- integrity


@query(
    "unresolved_refs_documents",
    "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def unresolved_refs_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return integrity.unresolved_refs(docs, "doc_id", table(spark, sf, "labels"), "doc_id")


@query(
    "unresolved_refs_parts",
    "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) "
    "GROUP BY 1",
)
def unresolved_refs_parts(spark, sf):
    small = table(spark, sf, "part").where("p_size <= 25")
    lines = table(spark, sf, "lineitem").select("l_partkey")
    missing = integrity.unresolved_refs(lines, "l_partkey", small, "p_partkey")
    return missing.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unresolved_names",
    "WITH d AS (SELECT concat('demo.', replace(p_name, ' ', '_')) AS full_name FROM part WHERE p_size <= 10), "
    "r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'int32' WHEN p_partkey % 3 = 1 THEN "
    "concat('.demo.', replace(p_name, ' ', '_')) ELSE concat('other.', p_brand) END AS ref FROM part) "
    "SELECT p_partkey, ref FROM r WHERE ref <> 'int32' AND regexp_replace(ref, '^\\.', '') NOT IN (SELECT full_name FROM d) "
    "AND regexp_extract(ref, '([^.]*)$', 1) NOT IN (SELECT regexp_extract(full_name, '([^.]*)$', 1) FROM d)",
)
def unresolved_names(spark, sf):
    parts = table(spark, sf, "part").withColumn("word", F.replace("p_name", F.lit(" "), F.lit("_")))
    declared = parts.where("p_size <= 10").select(F.concat(F.lit("demo."), "word").alias("full_name"))
    ref = (
        F.when(F.col("p_partkey") % 3 == 0, "int32")
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(".demo."), "word"))
        .otherwise(F.concat(F.lit("other."), "p_brand"))
    )
    refs = parts.select("p_partkey", ref.alias("ref"))
    return integrity.unresolved_names(refs, "ref", declared, "full_name", ["int32"])


_LINE_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]


@query(
    "duplicate_numbers",
    "SELECT l_orderkey, l_linenumber, holder, repeat FROM (SELECT l_orderkey, l_linenumber, lag(l_partkey) OVER w AS holder, "
    "l_partkey AS repeat FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY "
    + ", ".join(_LINE_ORDER)
    + ")) d WHERE holder IS NOT NULL",
)
def duplicate_numbers(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_LINE_ORDER)
    return integrity.duplicate_numbers(lines, "l_orderkey", "l_linenumber", "l_partkey", _LINE_ORDER)


# ----------------------------------------------------------------- exports


@query(
    "tsv_lines",
    "SELECT doc_id, concat(CAST(doc_id AS VARCHAR), chr(9), CASE WHEN regexp_matches(text, '[\\t\\r\\n\"]') THEN "
    "concat('\"', replace(text, '\"', '\"\"'), '\"') ELSE text END, chr(9), lang) AS line FROM documents",
)
def tsv_lines(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", export.tsv_line(docs, ["doc_id", "text", "lang"]).alias("line"))


@query(
    "json_records",
    "SELECT doc_id, to_json(struct_pack(doc_id := doc_id, lang := lang, \"Column 3\" := quality, lang_2 := toxic)) AS record "
    f"FROM {_LABELLED_SQL}",
)
def json_records(spark, sf):
    labelled = _labelled(spark, sf)
    return labelled.select("doc_id", export.json_record(labelled, ["doc_id", "lang", "", "lang"]).alias("record"))


@query(
    "json_records_ragged",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN to_json(struct_pack(status := o_orderstatus, priority := NULL)) "
    "WHEN 1 THEN to_json(struct_pack(status := o_orderstatus, priority := o_orderpriority)) "
    "ELSE to_json(struct_pack(status := o_orderstatus, priority := o_orderpriority, \"Column 3\" := 'extra')) END AS record "
    "FROM orders",
)
def json_records_ragged(spark, sf):
    orders = table(spark, sf, "orders")
    cells = F.slice(F.array("o_orderstatus", "o_orderpriority", F.lit("extra")), F.lit(1), (F.col("o_orderkey") % 3).cast("int") + 1)
    return orders.select("o_orderkey", export.ragged_record(cells, ["status", "priority"], 3).alias("record"))


@query(
    "pretty_records",
    "SELECT c_custkey, concat('{', chr(10), '  \"c_custkey\": ', c_custkey, ',', chr(10), '  \"c_name\": \"', c_name, '\"', "
    "chr(10), '}') AS record FROM customer",
)
def pretty_records(spark, sf):
    customer = table(spark, sf, "customer")
    return customer.select("c_custkey", export.pretty_record(customer, ["c_custkey", "c_name"]).alias("record"))


@query(
    "column_text",
    "SELECT c_custkey // 200 AS page, string_agg(c_name, chr(10) ORDER BY c_custkey) AS text FROM customer GROUP BY 1",
)
def column_text(spark, sf):
    """A column's cells as text, one text per page of two hundred rows."""
    customer = table(spark, sf, "customer").withColumn("page", F.floor(F.col("c_custkey") / 200).cast("long"))
    return export.column_text(customer, "c_name", ["c_custkey"], ["page"])


@query(
    "column_lines",
    "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_name AS line FROM customer",
)
def column_lines(spark, sf):
    return export.column_lines(table(spark, sf, "customer"), "c_name", ["c_custkey"])


@query(
    "parquet_window",
    "SELECT s_suppkey, s_name, pos FROM (SELECT s_suppkey, s_name, row_number() OVER () - 1 AS pos FROM supplier) s WHERE pos >= 20 AND pos < 60",
)
def parquet_window(spark, sf):
    """Rows by their place in the file, not by a key."""
    return columnar.read_parquet_window(spark, f"{sf}/supplier.parquet", ["s_suppkey", "s_name"], 20, 40)
