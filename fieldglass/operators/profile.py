"""Column profiles, column types, counts by kind and one-row summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.cells import (
    INTEGER_TYPES,
    NUMERIC_TYPES,
    cell_text,
    finite_or_null,
    is_blank,
    number_or_null,
    timestamp_or_null,
)


def _views(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(is blank, numeric value or null) of a column, cheapest form per type."""
    dtype = df.schema[name].dataType
    cell = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return is_blank(cell), number_or_null(cell)
    if isinstance(dtype, INTEGER_TYPES):
        return cell.isNull(), cell.cast("double")
    if isinstance(dtype, NUMERIC_TYPES):
        return cell.isNull(), finite_or_null(cell)
    return cell.isNull(), F.lit(None).cast("double")


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: totals, blanks and, for numeric columns, mean/min/max.

    A column is numeric when it has a non-blank cell and every non-blank cell
    is a number. One scan with partial aggregation feeds all columns.
    """
    names = columns or df.columns
    cells, aggs = [], []
    for i, name in enumerate(names):
        blank, number = _views(df, name)
        counted = isinstance(df.schema[name].dataType, (T.StringType, T.FloatType, T.DoubleType))
        cells.append(number.alias(f"v{i}"))
        if counted:
            cells.append(F.when(~blank, True).alias(f"b{i}"))
            aggs += [F.count(f"b{i}").alias(f"f{i}"), F.count(f"v{i}").alias(f"n{i}")]
        else:
            # Here a cell that is not null is filled, and numeric if its type is.
            cells.append(F.when(~blank, True).alias(f"b{i}"))
            filled = F.count(f"b{i}")
            numeric = isinstance(df.schema[name].dataType, NUMERIC_TYPES)
            aggs += [filled.alias(f"f{i}"), (filled if numeric else F.lit(0).cast("long")).alias(f"n{i}")]
        aggs += [F.sum(f"v{i}").alias(f"s{i}"), F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}")]
    totals = df.select(*cells).agg(F.count(F.lit(1)).alias("total"), *aggs)

    def line(i: int, name: str) -> Column:
        filled, numbers, total = F.col(f"f{i}"), F.col(f"n{i}"), F.col("total")
        numeric = (filled > 0) & (filled == numbers)
        return F.struct(
            F.lit(i).alias("column_index"),
            F.lit(name).alias("column_name"),
            total.alias("total"),
            filled.alias("filled"),
            (total - filled).alias("blank"),
            F.when(total == 0, 0.0).otherwise((total - filled) / total).alias("blank_share"),
            numeric.alias("is_numeric"),
            F.when(numeric, F.col(f"s{i}") / numbers).alias("mean"),
            F.when(numeric, F.col(f"lo{i}")).alias("min"),
            F.when(numeric, F.col(f"hi{i}")).alias("max"),
        )

    return totals.select(F.inline(F.array(*[line(i, n) for i, n in enumerate(names)])))


def column_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: ``number``, ``date`` or ``text``, from all its values."""
    names = columns or df.columns
    aggs = []
    for i, name in enumerate(names):
        dtype = df.schema[name].dataType
        blank, number = _views(df, name)
        if isinstance(dtype, T.StringType):
            dated = F.count(timestamp_or_null(F.col(f"`{name}`")))
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            dated = F.count(F.col(f"`{name}`"))
        else:
            dated = F.lit(0).cast("long")
        aggs += [F.count_if(~blank).alias(f"f{i}"), F.count(number).alias(f"n{i}"), dated.alias(f"d{i}")]

    def line(i: int, name: str) -> Column:
        filled = F.col(f"f{i}")
        kind = (
            F.when(filled == 0, "text")
            .when(filled == F.col(f"n{i}"), "number")
            .when(filled == F.col(f"d{i}"), "date")
            .otherwise("text")
        )
        return F.struct(
            F.lit(i).alias("column_index"), F.lit(name).alias("column_name"), filled.alias("filled"), kind.alias("kind")
        )

    return df.agg(*aggs).select(F.inline(F.array(*[line(i, n) for i, n in enumerate(names)])))


def top_kinds(df: DataFrame, kind: Column, limit: int | None = None) -> DataFrame:
    """Rows per kind, most frequent first, equal counts by kind."""
    counts = df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.asc("kind"))
    return ordered if limit is None else ordered.limit(limit)


def kpi_row(df: DataFrame, counts: dict[str, Column], maxima: dict[str, Column] | None = None) -> DataFrame:
    """One row: the total, a conditional count per name and maxima (0 when empty)."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(cond).alias(name) for name, cond in counts.items()],
        *[F.coalesce(F.max(c), F.lit(0)).alias(name) for name, c in (maxima or {}).items()],
    )


def marker_counts(df: DataFrame, text: Column, markers: list[str], keys: list[str]) -> DataFrame:
    """Non-overlapping occurrences of each literal marker per document, zeros dropped."""

    def count(marker: str) -> Column:
        missing = F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))
        return F.struct(F.lit(marker).alias("marker"), (missing / len(marker)).cast("long").alias("n"))

    hits = F.filter(F.array(*[count(m) for m in markers]), lambda r: r["n"] > 0)
    return df.select(*keys, F.inline(hits))


def raw_payload(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Every row with its cells in declared order beside the table's name and size.

    The size is one number from a count that reads no column.
    """
    cells = F.array(*[cell_text(F.col(f"`{c}`"), df.schema[c].dataType, "") for c in columns])
    return df.select(
        F.lit(name).alias("name"),
        F.to_json(cells).alias("cells"),
        F.lit(len(columns)).alias("total_columns"),
        F.lit(df.count()).cast("long").alias("total_rows"),
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)

