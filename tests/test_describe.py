"""Catalog and load checks: shape only, absent tables reported, horizon guard."""

import pytest
from pyspark.sql import functions as F

from wardlens.operators import describe as D


def test_schema_summary_reports_absent_tables(spark):
    t = {"b": spark.range(3).toDF("x"), "a": spark.range(2).toDF("y")}
    rows = [r.asDict() for r in D.schema_summary(t, expected=["a", "b", "c"]).collect()]
    by = {r["table_name"]: r for r in rows}
    assert by["a"]["row_count"] == 2 and by["b"]["columns"] == "x"
    assert by["c"]["status"] == "absent" and by["c"]["row_count"] is None


def test_table_profile_is_shape_only(spark):
    df = spark.createDataFrame([(1, "a")], "k bigint, v string")
    rows = D.table_profile(df, "t").orderBy("position").collect()
    assert [(r["column_name"], r["data_type"], r["row_count"]) for r in rows] == [("k", "bigint", 1), ("v", "string", 1)]


def test_horizon_check_raises_when_starts_reach_the_end(spark):
    s = spark.createDataFrame([("2020-01-01 00:00:00",)], "s string").select(
        F.col("s").cast("timestamp_ntz").alias("start_ts"))
    assert D.horizon_check(s, "2021-01-01").collect()[0]["horizon_ok"]
    with pytest.raises(Exception):
        D.horizon_check(s, "2019-01-01").collect()


def test_ordered_sample_puts_nulls_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    assert [r["x"] for r in D.sample_rows(df, 3).collect()] == [1, 2, None]
