"""Registered seed questions (survey 2.15) on the injected driver warehouse."""

from __future__ import annotations

from ..operators import questions as QS
from . import bindings as B
from .q_quality import MESSY
from .registry import query
from .sqlparts import RATE_COLS, readmission_sql

IP = f"'{B.INPATIENT}'"
P0, P1 = f"TIMESTAMP '{B.PERIOD_START}'", f"TIMESTAMP '{B.PERIOD_END}'"


def _wh(spark, sf):
    from .q_quality import injected
    wh, _, _ = injected(spark, sf)
    return wh


def _stays(spark, sf):
    return QS.warehouse_stays(_wh(spark, sf))


WST = MESSY + f""",
wraw AS (SELECT e.Id AS id, e.Id AS okey, 0 AS lnum, e.START AS start_ts, e.STOP AS stop_ts, e.PATIENT AS patient,
  coalesce(o.NAME || '|' || o.CITY, e.ORGANIZATION) AS organization, e.ORGANIZATION AS org_id, e.ENCOUNTERCLASS AS class,
  coalesce(upper(trim(p.NAME)), 'uninsured') AS payer, NULL::DOUBLE AS cost, NULL::DOUBLE AS covered, NULL::VARCHAR AS cause
  FROM enc5 e LEFT JOIN org1 o ON o.Id = e.ORGANIZATION LEFT JOIN pay2 p ON p.Id = e.PAYER),
stays AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stop_ts ASC NULLS LAST,
  organization ASC NULLS LAST, cost ASC NULLS LAST, org_id ASC NULLS LAST, covered ASC NULLS LAST, cause ASC NULLS LAST) AS rn
  FROM wraw) WHERE rn = 1),
flagged AS (SELECT *, stop_ts IS NULL AS is_open, coalesce(stop_ts < start_ts, false) AS is_reversed,
  stop_ts IS NOT NULL AND NOT coalesce(stop_ts < start_ts, false) AS is_complete FROM stays)"""

LOS = "least(date_diff('day', CAST(start_ts AS DATE), CAST(stop_ts AS DATE)), 365)"


@query("q1_org_volume", WST + f""", g AS (SELECT organization, count(DISTINCT id) AS n_encounters FROM flagged
  WHERE class = {IP} AND start_ts >= {P0} AND start_ts < {P1} GROUP BY 1)
SELECT organization, n_encounters, CAST(row_number() OVER (ORDER BY n_encounters DESC, organization) AS INTEGER) AS rank
FROM g ORDER BY n_encounters DESC, organization LIMIT 10""")
def q_q1(spark, sf):
    return QS.q1_org_volume(_stays(spark, sf), B.recipe())


@query("q2_admissions", WST + f"""
SELECT count(DISTINCT id) AS n_admissions, count(DISTINCT id) FILTER (WHERE is_open) AS n_open_included
FROM flagged WHERE class = {IP} AND start_ts >= {P0} AND start_ts < {P1}""")
def q_q2(spark, sf):
    return QS.q2_admissions(_stays(spark, sf), B.recipe())


@query("q3_los", WST + f"""
SELECT count(*) FILTER (WHERE is_complete) AS n_measured,
  round(avg(CASE WHEN is_complete THEN {LOS} END)::DOUBLE, 6) AS mean_los,
  round(quantile_cont(CASE WHEN is_complete THEN {LOS} END, 0.5)::DOUBLE, 6) AS median_los,
  round(quantile_cont(CASE WHEN is_complete THEN {LOS} END, 0.9)::DOUBLE, 6) AS p90_los,
  round(avg(CASE WHEN is_complete THEN (CASE WHEN {LOS} > 7 THEN 1.0 ELSE 0.0 END) END)::DOUBLE, 9) AS share_over_7,
  count(*) FILTER (WHERE is_open) AS n_open_excluded, count(*) FILTER (WHERE is_reversed) AS n_reversed_excluded
FROM flagged WHERE class = {IP}""")
def q_q3(spark, sf):
    return QS.q3_los(_stays(spark, sf), B.recipe())


@query("q4_readmission_by_org", WST + readmission_sql(30, exclude_transfers=True) + f"""
SELECT {RATE_COLS}, 'overall' AS scope FROM idx
UNION ALL (SELECT {RATE_COLS}, organization FROM idx GROUP BY organization
  ORDER BY count(*) FILTER (WHERE eligible) DESC, organization LIMIT 2)""")
def q_q4(spark, sf):
    return QS.q4_readmission_by_org(_stays(spark, sf), B.recipe())


@query("q5_payer_mix", WST + f""",
x AS (SELECT id, payer AS payer_key FROM flagged WHERE class = {IP} AND start_ts >= {P0} AND start_ts < {P1})
SELECT payer_key, count(DISTINCT id) AS n_encounters, (SELECT count(DISTINCT id) FROM x) AS denominator,
  round(count(DISTINCT id)::DOUBLE / (SELECT count(DISTINCT id) FROM x), 9) AS share FROM x GROUP BY payer_key""")
def q_q5(spark, sf):
    return QS.q5_payer_mix(_stays(spark, sf), B.recipe())


@query("q6_inpatient_2023", MESSY + f"""
SELECT count(DISTINCT Id) AS n_encounters, count(*) AS n_rows FROM enc5
WHERE ENCOUNTERCLASS = {IP} AND START >= {P0} AND START < {P1}""")
def q_q6(spark, sf):
    return QS.q6_inpatient_count(_wh(spark, sf).encounters, B.recipe())


@query("q7_same_org", WST + readmission_sql(30, same_facility=True, exclude_transfers=True)
       + f" SELECT {RATE_COLS}, count(*) FILTER (WHERE x_tail) AS n_tail_excluded FROM idx")
def q_q7(spark, sf):
    return QS.q7_same_org(_stays(spark, sf), B.recipe())
