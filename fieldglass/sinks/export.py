"""Tab-separated lines, JSON records, column text and edited line files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.cells import cell_text
from fieldglass.functions.formatting import escape_tsv
from fieldglass.operators.ordering import SortKey, with_positions


def unique_headers(headers: list[str | None]) -> list[str]:
    """Header names made unique: blanks become ``Column N``, repeats get ``_2``, ``_3``."""
    taken: dict[str, int] = {}
    names = []
    for i, header in enumerate(headers):
        base = (header or "").strip() or f"Column {i + 1}"
        name, n = base, taken.get(base, 0)
        if n:
            n += 1
            while f"{base}_{n}" in taken:
                n += 1
            name = f"{base}_{n}"
            taken[name] = 1
        taken[base] = max(n, 1)
        names.append(name)
    return names


def tsv_header(columns: list[str]) -> str:
    quoted = [f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in '\t\r\n"') else c for c in columns]
    return "\t".join(quoted)


def tsv_line(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One tab-separated line per row; nulls are empty cells."""
    cells = [escape_tsv(cell_text(F.col(f"`{c}`"), df.schema[c].dataType, "")) for c in columns or df.columns]
    return F.concat_ws("\t", *cells)


def json_record(df: DataFrame, headers: list[str | None] | None = None) -> Column:
    """One JSON object per row, keys unique, nulls kept."""
    names = unique_headers(list(headers or df.columns))
    cells = [F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def ragged_record(cells: Column, headers: list[str | None], width: int) -> Column:
    """A JSON object from an array of cells: short rows end in nulls, cells
    beyond the headers get ``Column N`` keys. ``width`` is the widest row."""
    names = unique_headers(headers)
    used = set(names)
    extra = []
    for i in range(len(names), width):
        name, n = f"Column {i + 1}", 2
        while name in used:
            name, n = f"Column {i + 1}_{n}", n + 1
        used.add(name)
        extra.append(name)
    fixed = [F.get(cells, F.lit(i)) for i in range(len(names))]
    base = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*fixed))
    if not extra:
        return F.to_json(base, {"ignoreNullFields": "false"})
    there = F.slice(F.array(*[F.lit(n) for n in extra]), F.lit(1), F.greatest(F.size(cells) - len(names), F.lit(0)))
    more = F.map_from_arrays(there, F.slice(cells, F.lit(len(names) + 1), F.size(there)))
    return F.to_json(F.map_concat(base, more), {"ignoreNullFields": "false"})


def pretty_record(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One indented JSON object per row, two spaces per level for flat rows."""
    lines = []
    for c in columns or df.columns:
        value = F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"})
        label = '  "' + c.replace("\\", "\\\\").replace('"', '\\"') + '": '
        lines.append(F.concat(F.lit(label), F.substring(value, F.lit(6), F.length(value) - 6)))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def column_lines(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """A column's cells as ordered lines ``(pos, line)``; nulls are empty lines.

    Writing these lines in order gives the newline-joined text of the column
    without ever holding it in one task.
    """
    dtype = df.schema[column].dataType
    text = cell_text(F.col(f"`{column}`"), dtype, "").alias("line")
    slim = df.select(*order, text)
    return with_positions(slim, [SortKey(F.col(c)) for c in order]).select("pos", "line")


def column_text(df: DataFrame, column: str, order: list[str], group: list[str]) -> DataFrame:
    """Newline-joined cells of a column per group of bounded size, e.g. a page."""
    text = cell_text(F.col(f"`{column}`"), df.schema[column].dataType, "")
    return df.groupBy(*group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))), lambda s: s["_t"]), "\n"
        ).alias("text")
    )


def write_ordered_lines(lines: DataFrame, order: list[str], text: str, path: str) -> None:
    """Write text files whose concatenation in name order is the ordered lines."""
    keys = [F.col(c) for c in order]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.col(text).cast(T.StringType())).write.text(path)
