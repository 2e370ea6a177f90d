"""Search in every column at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.cells import INTEGER_TYPES, NUMERIC_TYPES, cell_text
from fieldglass.operators.profile import any_of


def _can_match(term: str, dtype: T.DataType, null_text: str) -> bool:
    """Whether a cell of this type could hold the term at all.

    Number and boolean cells have a known alphabet, so a term outside of it
    rules the column out before the plan is built.
    """
    if term in null_text:
        return True
    if isinstance(dtype, INTEGER_TYPES):
        return re.fullmatch(r"-?[0-9]*", term) is not None
    if isinstance(dtype, NUMERIC_TYPES):
        return re.fullmatch(r"[-+.e0-9]*", term) is not None or term in "-infinity" or term in "nan"
    if isinstance(dtype, T.BooleanType):
        return term in "true" or term in "false"
    return True


def row_matches(df: DataFrame, term: str, null_text: str = "null", columns: list[str] | None = None) -> Column:
    """True when any cell holds the term, whatever the case; the term is literal."""
    needle = term.lower()
    if not needle:
        return F.lit(True)
    found = []
    for name in columns or df.columns:
        dtype = df.schema[name].dataType
        if _can_match(needle, dtype, null_text):
            found.append(F.contains(F.lower(cell_text(F.col(f"`{name}`"), dtype, null_text)), F.lit(needle)))
    return any_of(found)


def search_rows(df: DataFrame, term: str, null_text: str = "null") -> DataFrame:
    """Rows with the term in any column; an empty term keeps all rows."""
    return df if not term else df.where(row_matches(df, term, null_text))


def search_counts(df: DataFrame, term: str, null_text: str = "") -> DataFrame:
    """One row: how many rows match, and how many there are."""
    return df.agg(
        F.count_if(row_matches(df, term, null_text)).alias("visible"), F.count(F.lit(1)).alias("total")
    )


def path_contains(df: DataFrame, path: Column, query: str) -> DataFrame:
    """Members whose path holds the trimmed query, whatever the case."""
    needle = query.strip().lower()
    return df.where(F.contains(F.lower(path), F.lit(needle))) if needle else df
