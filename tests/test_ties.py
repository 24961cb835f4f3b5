"""Versions equal in all that orders them: the one read first, as in the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.plans import registry

LINES = [
    # order, line number, discount, ship date
    (1, 1, 0.07, "2024-01-02"), (1, 1, 0.01, "2024-01-02"),
    (2, 1, 0.01, "2024-01-02"), (2, 1, 0.07, "2024-01-02"),
    (3, 1, 0.07, "2024-01-01"), (3, 1, None, "2024-01-02"),  # the newest has no discount
    (4, 1, 0.07, None), (4, 1, 0.01, "2024-01-02"),  # no date
    (5, None, 0.07, "2024-01-02"), (5, 9, 0.01, "2024-01-02"),  # no number
    (6, 2, 0.07, "2024-01-02"), (6, 1, 0.01, "2024-01-02"),
]


@pytest.mark.parametrize("backwards", [False, True])
def test_capability_absence_on_ties(spark, tmp_path, backwards):
    rows = [(k, n, d, None if day is None else f"{day} 00:00:00", "N", "O") for k, n, d, day in (LINES[::-1] if backwards else LINES)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double, l_shipdate string, l_returnflag string, l_linestatus string")
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(2):  # two files, the first with the first half
        half = spark.createDataFrame(lines.collect()[k * 6 : k * 6 + 6], lines.schema).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
        half.coalesce(1).write.parquet(f"{tmp_path}/made{k}")
        next((tmp_path / f"made{k}").glob("part-*.parquet")).rename(tmp_path / f"lineitem.parquet/{k}.parquet")
    spark.createDataFrame([(k, "1-URGENT") for k in range(1, 7)], "o_orderkey long, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect(config={"threads": 1})
    for t in ("orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(r["o_orderkey"] for r in registry.queries()["capability_absence"](spark, str(tmp_path)).collect())
    assert got == sorted(k for (k,) in con.sql(registry.oracle_sql()["capability_absence"]).fetchall())
    assert got == ([2, 3, 4, 5, 6] if backwards else [1, 3, 4, 5, 6])
