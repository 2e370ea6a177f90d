"""Split points of an order, as literals, so that a row's part depends on the row alone.

A random sample of the sort keys is collected once; every so many sampled rows give a
split point, which is written into the plan as a literal. A row finds its part by binary
search over the split points, comparing all keys with their directions. Which task
computes a row, or computes it again after a loss, cannot change its part, so nothing
has to be pinned between the passes that count parts and the pass that uses them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.binding import let

#: Parts that an order is cut into at most; sampled rows per part.
MOST_PARTS, SAMPLES_PER_PART = 4096, 64
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


@dataclass(frozen=True)
class SortKey:
    """One sort expression with its direction; nulls go last when ascending."""

    expr: Column
    ascending: bool = True

    def forward(self) -> Column:
        return self.expr.asc_nulls_last() if self.ascending else self.expr.desc_nulls_first()

    def before(self, other: Column) -> Column:
        """Whether this key's value goes before ``other``; never null."""
        mine = self.expr
        if self.ascending:
            return (mine.isNotNull() & other.isNull()) | F.coalesce(mine < other, F.lit(False))
        return (mine.isNull() & other.isNotNull()) | F.coalesce(mine > other, F.lit(False))


def numbers(values: list[int]) -> Column:
    """A literal array of whole numbers."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


@dataclass(frozen=True)
class Splits:
    """Split points, as JSON texts in order, of the keys of a frame."""

    keys: list[SortKey]
    schema: T.StructType
    points: list[str]

    def _array(self) -> Column:
        return F.from_json(F.lit("[" + ",".join(self.points) + "]"), T.ArrayType(self.schema), _JSON)

    def _row_before(self, point: Column) -> Column:
        found = F.lit(False)
        for key, field in reversed(list(zip(self.keys, self.schema.names, strict=True))):
            other = point[field]
            found = key.before(other) | (key.expr.eqNullSafe(other) & found)
        return found

    def part(self) -> Column:
        """How many split points do not go behind the row: the number of its part."""
        if not self.points:
            return F.lit(0)
        n = len(self.points)
        both = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            narrowed = let(
                F.get(self._array(), mid),
                lambda p: F.when(self._row_before(p), both(acc["lo"], mid)).otherwise(both(mid + 1, acc["hi"])),
            )
            return F.when(acc["lo"] < acc["hi"], narrowed).otherwise(acc)

        steps = F.sequence(F.lit(1), F.lit(n.bit_length()))
        return F.aggregate(steps, both(F.lit(0), F.lit(n)), halve, lambda acc: acc["lo"])

    def touches(self, part: Column, names: list[str]) -> Column:
        """Whether a split point beside the row's part has the row's values in the first keys."""
        if not self.points:
            return F.lit(False)
        count = len(names)

        def same(point: Column) -> Column:
            met = point.isNotNull()
            for key, field in list(zip(self.keys, self.schema.names, strict=True))[:count]:
                met = met & key.expr.eqNullSafe(point[field])
            return met

        return let(F.get(self._array(), part - 1), same) | let(F.get(self._array(), part), same)


def _sampled(df: DataFrame, keys: list[SortKey], total: int, parts: int, lead: int) -> tuple[T.StructType, list]:
    """Sampled keys in order with their rows, and the first ``lead`` keys as text."""
    share = min(1.0, parts * SAMPLES_PER_PART / total)
    names = [f"k{i}" for i in range(len(keys))]
    plain = df.select(*[k.expr.alias(n) for k, n in zip(keys, names, strict=True)])
    drawn = plain.where(F.rand(17) < share) if share < 1 else plain
    # Equal keys are one row, so a value that fills the table sends one row a task.
    counted = drawn.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    order = [SortKey(F.col(n), k.ascending).forward() for k, n in zip(keys, names, strict=True)]
    text = lambda some: F.to_json(F.struct(*some), _JSON) if some else F.lit("")
    rows = counted.orderBy(*order).select(text(names).alias("point"), text(names[:lead]).alias("lead"), "n").collect()
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in plain.schema])
    return schema, rows


def split_evenly(df: DataFrame, keys: list[SortKey], total: int, part_rows: int, parts: int | None = None) -> Splits:
    """Split points that cut the whole order into parts of about ``part_rows`` rows."""
    parts = parts or min(MOST_PARTS, -(-total // part_rows))
    if total == 0 or parts <= 1:
        return Splits(keys, T.StructType(), [])
    schema, rows = _sampled(df, keys, total, parts, 0)
    fill = sum(r["n"] for r in rows) / parts
    points, seen = [], 0
    for r in rows:
        if seen >= fill * (len(points) + 1):
            points.append(r["point"])
        seen += r["n"]
    return Splits(keys, schema, points)


def split_large_groups(df: DataFrame, group: list[str], order: list[str], total: int, part_rows: int) -> Splits:
    """Split points inside the groups of more than about ``part_rows`` rows; all other groups stay whole."""
    keys = [SortKey(F.col(f"`{c}`")) for c in [*group, *order]]
    if total <= part_rows:
        return Splits(keys, T.StructType(), [])
    parts = min(MOST_PARTS, -(-total // part_rows))
    schema, rows = _sampled(df, keys, total, parts, len(group))
    step = sum(r["n"] for r in rows) / parts
    points, lead, seen, cut = [], None, 0, 0
    for r in rows:
        if r["lead"] != lead:
            lead, seen, cut = r["lead"], 0, 1
        elif seen >= step * cut:
            points.append(r["point"])
            cut += 1
        seen += r["n"]
    return Splits(keys, schema, points)
