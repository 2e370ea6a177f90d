"""Queries with SQL agree with it on the smallest tables; all are registered by number."""

import duckdb
import pytest
from fieldglass.llm.catalog import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog()


def test_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    res = con.execute(ORACLES[name])
    columns = [d[0] for d in res.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, df.select(*columns).collect())) == sorted(
        "Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(columns, row, strict=True)) + ")" for row in res.fetchall()
    )
