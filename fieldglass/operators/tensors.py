"""Array columns as tensors: shapes, element counts, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes per element of the array item types.
ITEM_BYTES = {"float": 4, "double": 8, "int": 4, "bigint": 8, "smallint": 2, "tinyint": 1, "boolean": 1}


def element_count(shape: Column) -> Column:
    """Product of a shape's dimensions; null when it leaves the 64-bit range."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda acc, d: F.try_multiply(acc, d.cast("long")))


def tensor_summary(df: DataFrame, array: str) -> DataFrame:
    """One row per (dtype, shape): arrays, elements and bytes."""
    dtype = dict(df.dtypes)[array].removeprefix("array<").removesuffix(">")
    return (
        df.where(F.col(array).isNotNull())
        .groupBy(F.lit(dtype).alias("dtype"), F.size(array).alias("shape"))
        .agg(
            F.count(F.lit(1)).alias("arrays"),
            F.sum(element_count(F.array(F.size(array)))).alias("elements"),
        )
        .withColumn("bytes", F.col("elements") * ITEM_BYTES[dtype])
    )


def tensor_slice(df: DataFrame, keys: list[str], array: str, start: int, length: int) -> DataFrame:
    """The values of positions ``start .. start+length-1`` (0-based) of every array."""
    part = F.slice(array, start + 1, length)
    return df.select(*keys, F.posexplode(part).alias("_i", "value")).select(
        *keys, (F.col("_i") + start).alias("element"), "value"
    )
