"""The seven seed questions, answered on an injected warehouse snapshot.

Each question goes through the rule that defuses its trap: de-duplicate by id,
count open stays, drop reversed stays from intervals, group organisations by
identity (name + city, so a merged id re-joins its facility), group payers by
normalised name (so a split payer re-joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import normalise_name
from ..plans.bindings import dedupe_stays
from . import metrics as M
from .quality import Recipe, Warehouse


def warehouse_stays(wh: Warehouse) -> DataFrame:
    """Stay roles over the warehouse: organisation = identity (NAME|CITY), payer =
    normalised payer name ('uninsured' when the id has no payer row); one row per id."""
    org = wh.organizations.select(F.col("Id").alias("ORGANIZATION"),
                                  F.concat_ws("|", "NAME", "CITY").alias("org_identity"))
    pay = wh.payers.select(F.col("Id").alias("PAYER"), normalise_name("NAME").alias("payer_key"))
    e = wh.encounters.join(org, "ORGANIZATION", "left").join(pay, "PAYER", "left")
    s = e.select(F.col("Id").alias("id"), F.col("Id").alias("okey"), F.lit(0).alias("lnum"),
                 F.col("START").alias("start_ts"), F.col("STOP").alias("stop_ts"), F.col("PATIENT").alias("patient"),
                 F.coalesce("org_identity", "ORGANIZATION").alias("organization"),
                 F.col("ORGANIZATION").alias("org_id"), F.col("ENCOUNTERCLASS").alias("class"),
                 F.coalesce("payer_key", F.lit("uninsured")).alias("payer"),
                 F.lit(None).cast("double").alias("cost"), F.lit(None).cast("double").alias("covered"),
                 F.lit(None).cast("string").alias("cause"))
    return dedupe_stays(s, keys=("id",))


def q1_org_volume(s: DataFrame, r: Recipe, top_n: int = 10) -> DataFrame:
    y0, y1 = r.payer_year
    g = M.scope(s, [r.inpatient], y0, y1).groupBy("organization").agg(F.count("*").alias("n_encounters"))
    w = Window.orderBy(F.desc("n_encounters"), F.asc("organization"))
    return g.orderBy(F.desc("n_encounters"), "organization").limit(top_n).withColumn("rank", F.row_number().over(w))


def q2_admissions(s: DataFrame, r: Recipe) -> DataFrame:
    y0, y1 = r.payer_year
    return M.admission_count(s, r.inpatient, y0, y1)


def q3_los(s: DataFrame, r: Recipe) -> DataFrame:
    return M.los_distribution(s, r.inpatient)


def q4_readmission_by_org(s: DataFrame, r: Recipe, top: int = 2) -> DataFrame:
    """30-day rate overall and for the two busiest organisations (by eligible index stays)."""
    y0, y1 = r.payer_year
    f = M.readmission_flags(s, r.inpatient, y0, y1, window_days=30, exclude_transfers=True)
    overall = f.agg(*M._rate_aggs()).withColumn("scope", F.lit("overall"))
    per = f.groupBy("organization").agg(*M._rate_aggs())
    busiest = per.orderBy(F.desc("n_eligible"), F.asc("organization")).limit(top)
    return overall.unionByName(busiest.withColumnRenamed("organization", "scope"))


def q5_payer_mix(s: DataFrame, r: Recipe) -> DataFrame:
    y0, y1 = r.payer_year
    return M.payer_mix_encounters(s, None, [r.inpatient], y0, y1)


def q6_inpatient_count(raw_encounters: DataFrame, r: Recipe) -> DataFrame:
    """Rows and distinct encounters side by side: the answer is the distinct count."""
    y0, y1 = r.dup_year
    w = raw_encounters.where((F.col("ENCOUNTERCLASS") == r.inpatient) & M.in_window("START", y0, y1))
    return w.agg(F.count_distinct("Id").alias("n_encounters"), F.count("*").alias("n_rows"))


def q7_same_org(s: DataFrame, r: Recipe) -> DataFrame:
    y0, y1 = r.payer_year
    return M.readmission_rate(s, r.inpatient, y0, y1, window_days=30, same_facility=True, exclude_transfers=True)
