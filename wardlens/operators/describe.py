"""Catalog, shape and load checks: one aggregation pass per table, no statistics
beyond what the reference reports (shape only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SAMPLE_ROWS
from .relational import ordered_sample


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``count(*)`` of each table, as one union of single-row aggregates."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def schema_summary(tables: dict[str, DataFrame], expected=()) -> DataFrame:
    """Per table: name, row count, column names; expected-but-absent tables reported."""
    parts = [df.agg(F.count("*").alias("row_count")).select(
        F.lit(n).alias("table_name"), "row_count", F.lit(",".join(df.columns)).alias("columns"),
        F.lit("present").alias("status")) for n, df in sorted(tables.items())]
    out = reduce(DataFrame.unionByName, parts)
    spark = out.sparkSession
    missing = sorted(set(expected) - set(tables))
    if missing:
        m = spark.createDataFrame([(n,) for n in missing], "table_name string").select(
            "table_name", F.lit(None).cast("bigint").alias("row_count"),
            F.lit(None).cast("string").alias("columns"), F.lit("absent").alias("status"))
        out = out.unionByName(m)
    return out


def table_profile(df: DataFrame, table: str) -> DataFrame:
    """Shape of one table: column, type, nullable, position, row count."""
    spark = df.sparkSession
    cols = spark.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)],
        "position int, column_name string, data_type string, nullable boolean")
    cnt = df.agg(F.count("*").alias("row_count")).scalar()
    return cols.select(F.lit(table).alias("table_name"), "position", "column_name",
                       "data_type", "nullable", cnt.alias("row_count"))


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    return ordered_sample(df, n)


def load_shape_report(stays: DataFrame, year_start: str, year_end: str, inpatient: str) -> DataFrame:
    """Class histogram, open-stay count, min/max start and inpatient-in-year count,
    as (metric, key, value) rows from one pass."""
    lo = F.lit(year_start).cast("timestamp_ntz")
    hi = F.lit(year_end).cast("timestamp_ntz")
    g = stays.groupBy("class").agg(
        F.count("*").alias("n"), F.count_if(F.col("stop_ts").isNull()).alias("n_open"),
        F.min("start_ts").alias("min_start"), F.max("start_ts").alias("max_start"),
        F.count_if((F.col("class") == inpatient) & (F.col("start_ts") >= lo) & (F.col("start_ts") < hi))
         .alias("n_inpatient_year"))
    hist = g.select(F.lit("class_count").alias("metric"), F.col("class").alias("key"),
                    F.col("n").cast("string").alias("value"))
    tot = g.agg(F.sum("n_open").cast("string").alias("open"),
                F.date_format(F.min("min_start"), "yyyy-MM-dd HH:mm:ss").alias("min_start"),
                F.date_format(F.max("max_start"), "yyyy-MM-dd HH:mm:ss").alias("max_start"),
                F.sum("n_inpatient_year").cast("string").alias("inpatient_year"))
    rest = tot.selectExpr("stack(4, 'open_stays', '', open, 'min_start', '', min_start, "
                          "'max_start', '', max_start, 'inpatient_in_year', '', inpatient_year) "
                          "AS (metric, key, value)")
    return hist.unionByName(rest)


def horizon_check(stays: DataFrame, horizon_end: str) -> DataFrame:
    """Fails (raises at execution) when the latest start is at or past the horizon
    end, or when there are no starts at all; otherwise returns the evidence row."""
    end = F.lit(horizon_end).cast("timestamp_ntz")
    a = stays.agg(F.max("start_ts").alias("max_start"), F.count("start_ts").alias("n_starts"))
    ok = (F.col("n_starts") > 0) & F.coalesce(F.col("max_start") < end, F.lit(False))
    return a.select("max_start", "n_starts", end.alias("horizon_end"),
                    F.when(ok, F.lit(True)).otherwise(
                        F.raise_error(F.lit(f"simulation did not end before {horizon_end}")).cast("boolean"))
                    .alias("horizon_ok"))
