"""Reference checks, repeated numbers, sparse edits and companion files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.ordering import BUCKET_ROWS, previous_in_group


def unresolved_refs(
    child: DataFrame, key: str, declared: DataFrame, declared_key: str, exempt: list[str] | None = None
) -> DataFrame:
    """Rows whose reference is not declared. Null references are kept out.

    The declared side is reduced to its keys before the join, so only keys are
    shuffled, and repeated references cost nothing extra on that side.
    """
    refs = child.where(F.col(key).isNotNull())
    if exempt:
        refs = refs.where(~F.col(key).isin(exempt))
    names = declared.select(F.col(declared_key).alias(key)).distinct()
    return refs.join(names, key, "left_anti")


def unresolved_names(
    refs: DataFrame, name: str, declared: DataFrame, full_name: str, scalars: list[str] | None = None
) -> DataFrame:
    """Dotted references that match neither a declared full name nor its last part."""
    short = lambda c: F.regexp_extract(c, r"([^.]*)$", 1)
    target = F.regexp_replace(F.col(name), r"^\.", "")
    open_refs = refs.withColumn("_full", target).withColumn("_short", short(target))
    if scalars:
        open_refs = open_refs.where(~F.col("_full").isin(scalars))
    full = declared.select(F.col(full_name).alias("_full")).distinct()
    last = declared.select(short(F.col(full_name)).alias("_short")).distinct()
    missing = open_refs.join(full, "_full", "left_anti").join(last, "_short", "left_anti")
    return missing.select(*refs.columns)


def duplicate_numbers(
    df: DataFrame, parent: str, number: str, name: str, order: list[str], bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Each repeat of a number within its parent beside the holder before it."""
    paired = previous_in_group(df, [parent, number], order, [name], bucket_rows, flag="_repeated")
    return paired.where("_repeated").select(
        parent, number, F.col(f"prev_{name}").alias("holder"), F.col(name).alias("repeat")
    )


def apply_edits(lines: DataFrame, edits: DataFrame, keys: list[str], text: str = "raw") -> DataFrame:
    """Lines with sparse edits laid over them; edits outside the lines are ignored.

    The last edit of a line wins through an aggregate, so a line never
    multiplies. The join strategy is left to the optimizer, which knows the
    size of the edits.
    """
    final = edits.groupBy(*keys).agg(F.max_by("new_raw", "edit_no").alias("_new"))
    return lines.join(final, keys, "left").select(*keys, F.coalesce("_new", text).alias(text))


def stem_of(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\.[^.]*$", "")


def companions(files: DataFrame, main_ext: str, side_ext: str) -> DataFrame:
    """Pair each ``main_ext`` file with its companion in the same directory.

    The companion has the same stem; failing that, it is the directory's only
    file of that kind. ``files`` has ``dir`` and ``name``.
    """
    main = files.where(F.lower("name").endswith(main_ext)).select("dir", "name", stem_of(F.col("name")).alias("_stem"))
    side = files.where(F.lower("name").endswith(side_ext)).select(
        "dir", F.col("name").alias("_side"), stem_of(F.col("name")).alias("_stem")
    )
    same = side.groupBy("dir", "_stem").agg(F.min("_side").alias("_same"))
    only = (
        side.groupBy("dir")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_side").alias("_only"))
        .where("_n = 1")
        .drop("_n")
    )
    return (
        main.join(same, ["dir", "_stem"], "left")
        .join(only, "dir", "left")
        .select(
            "dir",
            "name",
            F.coalesce("_same", "_only").alias("companion"),
            F.when(F.col("_same").isNotNull(), "stem").when(F.col("_only").isNotNull(), "only").otherwise("none").alias("rule"),
        )
    )
