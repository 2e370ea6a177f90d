"""Type-aware order, global positions, pages and load batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.cells import (
    INTEGER_TYPES,
    cell_text,
    collated,
    finite_or_null,
    natural_key,
    number_or_null,
    timestamp_or_null,
    trimmed,
)
from fieldglass.operators.profile import column_types
from fieldglass.operators.splits import MOST_PARTS, SortKey, Splits, numbers, split_evenly, split_large_groups
from fieldglass.sources.scratch import new_folder

PAGE_SIZE = 200
# Rows per load step of columnar and line-delimited files.
COLUMNAR_BATCH, LINES_BATCH = 10_000, 5_000
# Rows that one part of an order, or of a group, aims at.
PART_ROWS = BUCKET_ROWS = 100_000


def typed_sort_keys(
    df: DataFrame, column: str, direction: str, tie_breakers: list[str], kind: str | None = None
) -> list[SortKey]:
    """Keys that sort a column as its kind, blanks last in both directions.

    ``direction`` is ``asc``, ``desc`` or ``none``; ``none`` leaves the order of
    the tie-breakers.

    Numbers and dates compare by value, text by natural case-insensitive order.
    ``tie_breakers`` fix the order of equal cells; they also split a heavily
    repeated value over several ranges when the rows are distributed.
    """
    if direction not in ("asc", "desc", "none"):
        raise ValueError(f"unknown sort direction {direction!r}")
    if direction == "none":
        return [SortKey(F.col(f"`{c}`")) for c in tie_breakers]
    kind = kind or column_types(df, [column]).first()["kind"]
    dtype = df.schema[column].dataType
    cell = F.col(f"`{column}`")
    if kind == "number":
        if isinstance(dtype, T.StringType):
            key = number_or_null(cell)
        else:
            key = cell if isinstance(dtype, INTEGER_TYPES) else finite_or_null(cell)
        blank = key.isNull()
    elif kind == "date":
        key = timestamp_or_null(cell) if isinstance(dtype, T.StringType) else cell
        blank = key.isNull()
    else:
        text = trimmed(cell) if isinstance(dtype, T.StringType) else cell_text(cell, dtype, "")
        blank = F.coalesce(text, F.lit("")) == ""
        key = F.when(~blank, collated(natural_key(text)))
    ties = [SortKey(F.col(f"`{c}`")) for c in tie_breakers]
    return [SortKey(blank), SortKey(key, direction == "asc"), *ties]


def _keyed(df: DataFrame, keys: list[SortKey]) -> tuple[DataFrame, list[SortKey]]:
    """Compute each key once as a column; a sort would compute it per comparison."""
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.expr.alias(n) for k, n in zip(keys, names, strict=True)])
    return keyed, [SortKey(F.col(n), k.ascending) for k, n in zip(keys, names, strict=True)]


def _in_parts(
    df: DataFrame, keys: list[SortKey], total: int | None, part_rows: int, parts: int | None = None
) -> tuple[DataFrame, list[SortKey], list[int]]:
    """The rows with their keys and part, and how many rows lie before each part.

    Only the number of rows of each part reaches the driver.
    """
    keyed, plain = _keyed(df, keys)
    total = keyed.count() if total is None else total
    splits = split_evenly(keyed, plain, total, part_rows, parts)
    placed = keyed.withColumn("_part", splits.part())
    if not splits.points:
        return placed, plain, [0, total]
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0]
    for part in range(len(splits.points) + 1):
        starts.append(starts[-1] + counts.get(part, 0))
    return placed, plain, starts


def with_positions(
    df: DataFrame, keys: list[SortKey], name: str = "pos", partitions: int | None = None, part_rows: int = PART_ROWS
) -> DataFrame:
    """Add each row's 0-based place in the global order.

    The order is dealt over ranges of the keys, each range is sorted and written to one
    file below the shared folder, and a row's place is its place in its file and the
    rows of the files before. Written files stay as they are, whatever is computed
    again. Rows that a file cannot hold are placed by literal split points
    (``splits``) and a window over each part.
    """
    if not _writable(df.schema):
        placed, plain, starts = _in_parts(df, keys, None, part_rows, partitions)
        within = Window.partitionBy("_part").orderBy(*[k.forward() for k in plain])
        place = F.get(numbers(starts), F.col("_part")) + F.row_number().over(within) - 1
        return placed.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))
    parts = min(MOST_PARTS, partitions or max(1, -(-df.count() // part_rows)))
    keyed, plain = _keyed(df, keys)
    order = [k.forward() for k in plain]
    kept = [F.col(f"`{c}`") for c in df.columns]
    folder = new_folder(df.sparkSession, "positions")
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*kept)
    # One file a range, named by its number.
    ranged.write.option("maxRecordsPerFile", 0).parquet(folder)
    written = df.sparkSession.read.schema(df.schema).parquet(folder)
    part = F.substring("_metadata.file_name", 6, 5).cast("int")
    counts = {r["p"]: r["n"] for r in written.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0]
    for p in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(p, 0))
    return written.select(*kept, (F.get(numbers(starts), part) + F.col("_metadata.row_index")).alias(name))


def _writable(schema: T.StructType) -> bool:
    """Whether a file can hold the columns: told apart by name in any case, none of a type without values."""
    names = {f.name.lower() for f in schema}
    text = schema.simpleString()
    return len(names) == len(schema) and "_metadata" not in names and not any(t in text for t in ("void", "interval"))


def page_count(total: int, size: int) -> int:
    return 1 if total <= 0 or size <= 0 else max(1, -(-total // size))


def clamp_page(page: int, total: int, size: int) -> int:
    return min(max(page, 1), page_count(total, size))


def page_slice(
    df: DataFrame,
    keys: list[SortKey],
    page: int,
    size: int = PAGE_SIZE,
    total: int | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The rows of one 1-based page; the page number is clamped to what exists.

    The order is cut into parts, the rows of each are counted, and only the parts
    that hold the page are sorted: a page costs the same wherever it lies.
    """
    total = df.count() if total is None else total
    # Rows with equal keys are told apart by their content, so every cut gives the same pages.
    hashable = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [*keys, SortKey(F.xxhash64(*hashable))] if hashable else keys
    start = (clamp_page(page, total, size) - 1) * size
    placed, plain, starts = _in_parts(df, keys, total, part_rows)
    if len(starts) > 2:
        first = max(p for p in range(len(starts) - 1) if starts[p] <= start)
        last = max(p for p in range(len(starts) - 1) if starts[p] < max(start + size, 1))
        placed = placed.where(F.col("_part").between(first, last))
        start -= starts[first]
    kept = [F.col(f"`{c}`") for c in df.columns]
    return placed.orderBy(*[k.forward() for k in plain]).offset(start).limit(size).select(*kept)


def load_batches(positioned: DataFrame, size: int = COLUMNAR_BATCH, pos: str = "pos") -> DataFrame:
    """Rows per load step, with the running count and its share of the total.

    The running sum needs one ordered pass over the steps, so it works on the
    per-step counts only, at most one row per ``size`` input rows, and in two
    levels: sums within groups of steps, then over the groups.
    """
    steps = positioned.groupBy(F.floor(F.col(pos) / size).cast("long").alias("batch_no")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    grouped = steps.withColumn("_group", F.floor(F.col("batch_no") / 1000))
    inner = Window.partitionBy("_group").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, 0)
    before = (
        grouped.groupBy("_group")
        .agg(F.sum("rows").alias("_rows"))
        .withColumn(
            "_before",
            F.sum("_rows").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows"),
        )
        .withColumn("total", F.sum("_rows").over(Window.partitionBy()))
    )
    return (
        grouped.withColumn("_in", F.sum("rows").over(inner))
        .join(before, "_group")
        .select(
            "batch_no",
            "rows",
            (F.col("_before") + F.col("_in")).alias("loaded"),
            "total",
            ((F.col("_before") + F.col("_in")) / F.col("total")).alias("loaded_share"),
        )
    )


def _in_group_parts(
    df: DataFrame, group: list[str], order: list[str], part_rows: int
) -> tuple[DataFrame, Splits, Window]:
    """The rows with the part of their group, the split points, and the window over a part in order.

    Groups of more than about ``part_rows`` rows are cut into parts, all others are one
    part. The rows beside a split point, ``_cut``, lie in a group of several parts.
    """
    splits = split_large_groups(df, group, order, df.select(*group).count(), part_rows)
    placed = df.withColumn("_part", splits.part())
    placed = placed.withColumn("_cut", splits.touches(F.col("_part"), group))
    within = Window.partitionBy(*group, "_part").orderBy(*[SortKey(F.col(c)).forward() for c in order])
    return placed, splits, within


def _with_earlier(placed: DataFrame, splits: Splits, group: list[str], per_part: Column, earlier) -> DataFrame:
    """Add ``_earlier``: what ``earlier`` makes of ``per_part`` over the parts of the row's group before its own.

    Only groups with a split point have such parts, so there are at most twice as many as
    split points; that bounds the broadcast.
    """
    if not splits.points:
        return placed
    names = [f"_g{i}" for i in range(len(group))]
    renamed = [F.col(f"`{g}`").alias(n) for g, n in zip(group, names, strict=True)]
    parts = placed.where("_cut").groupBy(*renamed, F.col("_part").alias("_p")).agg(per_part.alias("_value"))
    before = Window.partitionBy(*names).orderBy("_p")
    told = parts.select(*names, "_p", earlier("_value", before).alias("_earlier"))
    same = F.col("_p") == F.col("_part")
    for g, n in zip(group, names, strict=True):
        same = same & F.col(n).eqNullSafe(F.col(f"`{g}`"))
    return placed.join(F.broadcast(told), same, "left").drop("_p", *names)


def previous_in_group(
    df: DataFrame,
    group: list[str],
    order: list[str],
    carried: list[str],
    bucket_rows: int = PART_ROWS,
    flag: str | None = None,
) -> DataFrame:
    """Add ``prev_<column>``: the carried cells of the row before in its group, and ``flag``: whether there is one.

    The first row of a part takes them from the last row of the part before. Null
    group keys are a group like any other.
    """
    placed, splits, within = _in_group_parts(df, group, order, bucket_rows)
    place = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    last = F.max_by(F.struct(F.lit(True).alias("_there"), *[F.col(c) for c in carried]), place)
    whole = _with_earlier(placed, splits, group, last, lambda value, w: F.lag(value).over(w))
    first = F.row_number().over(within) == 1
    earlier = (lambda c: F.col("_earlier")[c]) if splits.points else (lambda c: F.lit(None))
    out = whole.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.when(first, earlier(c)).otherwise(F.lag(c).over(within)).alias(f"prev_{c}") for c in carried],
        *([(~first | F.coalesce(earlier("_there").cast("boolean"), F.lit(False))).alias(flag)] if flag else []),
    )
    return out


def _running(df: DataFrame, group: list[str], order: list[str], amount: str, name: str, part_rows: int, fold, join, upto: int) -> DataFrame:
    placed, splits, within = _in_group_parts(df, group, order, part_rows)
    before = lambda value, w: fold(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    whole = _with_earlier(placed, splits, group, fold(amount), before)
    own = fold(amount).over(within.rowsBetween(Window.unboundedPreceding, upto))
    earlier = F.col("_earlier") if splits.points else F.lit(None).cast(df.schema[amount].dataType)
    total = F.coalesce(join(own, earlier), own, earlier)
    return whole.select(*[F.col(f"`{c}`") for c in df.columns], total.alias(name))


def running_sum(
    df: DataFrame, group: list[str], order: list[str], amount: str, name: str, bucket_rows: int = PART_ROWS
) -> DataFrame:
    """Add the running total of ``amount`` within each group, this row included.

    Each part of a group sums its own rows and adds the sums of the parts before. Null
    group keys are a group like any other.
    """
    return _running(df, group, order, amount, name, bucket_rows, F.sum, lambda a, b: a + b, 0)


def earlier_max(
    df: DataFrame, group: list[str], order: list[str], amount: str, name: str, bucket_rows: int = PART_ROWS
) -> DataFrame:
    """Add the greatest ``amount`` of the rows before in its group; null for the first."""
    return _running(df, group, order, amount, name, bucket_rows, F.max, lambda a, b: F.greatest(a, b), -1)
