"""Places in the global order, read back from sorted ranges."""

from fieldglass.operators import ordering
from fieldglass.operators.ordering import SortKey
from pyspark.sql import functions as F


def test_places_need_no_window_and_no_search_per_row(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("flag"))
    keys = [SortKey(F.col("flag"), False), SortKey(F.col("k"))]
    placed = ordering.with_positions(df, keys, part_rows=300)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "aggregate(" not in plan
    want = sorted(((r["k"], r["flag"]) for r in df.collect()), key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert [(r["k"], r["flag"]) for r in sorted(placed.collect(), key=lambda r: r["pos"])] == want
    assert sorted(r["pos"] for r in placed.collect()) == list(range(5000))


def test_places_of_rows_that_no_file_holds_and_of_none(spark):
    df = spark.range(50).select("id", F.lit(None).alias("nothing"), F.expr("make_interval(1)").alias("span"))
    placed = ordering.with_positions(df, [SortKey(F.col("id"), False)], part_rows=7)
    assert {r["id"]: r["pos"] for r in placed.select("id", "pos").collect()} == {i: 49 - i for i in range(50)}
    none = ordering.with_positions(spark.range(0), [SortKey(F.col("id"))])
    assert none.columns == ["id", "pos"] and none.collect() == []
