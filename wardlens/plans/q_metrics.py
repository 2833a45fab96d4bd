"""Registered metric queries (survey 2.14) on the B-STAY binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import bindings as B
from .registry import query
from .sqlparts import (ED, HOURS, IN_PERIOD, IP, LOS, MIDNIGHTS, OBS, P0, P1, RATE_COLS, STAYS,
                       EXCLUSION_TABLES, SUPPLIER_ORG, readmission_sql, transfer_pairs_sql)

IPC, P, E = B.INPATIENT, B.PERIOD_START, B.PERIOD_END
AS_OF = B.PERIOD_END
BEDS_PER_ORG = 500


def _stays(spark, sf, classes=None, window=None):
    return B.stays(spark, sf, classes, window)


PW = (P, E)   # period as a start-date window pushed to the orders scan


def orgs(spark, sf):
    """Organisation dimension of the binding: supplier id, region name, nation as city."""
    from ..sources.tables import read_table
    sup = read_table(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    nat = read_table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    reg = read_table(spark, sf, "region", "r_regionkey", "r_name")
    return (sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey)
               .join(F.broadcast(reg), F.col("n_regionkey") == reg.r_regionkey)
               .select(F.col("s_suppkey").alias("org_key"), F.col("r_name").alias("name"),
                       F.col("n_name").alias("city"), F.col("n_regionkey").alias("region_key")))


@query("encounter_dedup", f"WITH {STAYS} SELECT id, start_ts, stop_ts, patient, organization, class, cost FROM stays")
def q_encounter_dedup(spark, sf):
    return _stays(spark, sf).select("id", "start_ts", "stop_ts", "patient", "organization", "class", "cost")


@query("admission_count", f"""WITH {STAYS}
SELECT count(DISTINCT id) AS n_admissions, count(DISTINCT id) FILTER (WHERE is_open) AS n_open_included
FROM flagged WHERE class = {IP} AND {IN_PERIOD}""")
def q_admission_count(spark, sf):
    return M.admission_count(_stays(spark, sf, [IPC], PW), IPC, P, E)


@query("encounter_volume", f"""WITH {STAYS}
SELECT class, count(DISTINCT id) AS n_encounters FROM flagged WHERE {IN_PERIOD} GROUP BY class""")
def q_encounter_volume(spark, sf):
    return M.encounter_volume(_stays(spark, sf, None, PW), P, E)


@query("patient_volume", f"""WITH {STAYS}
SELECT count(DISTINCT patient) AS n_patients FROM flagged WHERE class = {IP} AND {IN_PERIOD}""")
def q_patient_volume(spark, sf):
    return M.patient_volume(_stays(spark, sf, [IPC], PW), [IPC], P, E)


@query("ed_visits", f"""WITH {STAYS}
SELECT count(DISTINCT id) AS n_ed_visits FROM flagged WHERE class = {ED} AND {IN_PERIOD}""")
def q_ed_visits(spark, sf):
    return M.ed_visits(_stays(spark, sf, [B.EMERGENCY], PW), B.EMERGENCY, P, E)


@query("ed_admission_rate", f"""WITH {STAYS},
ed AS (SELECT id, patient, start_ts FROM flagged WHERE class = {ED} AND {IN_PERIOD}),
f AS (SELECT id, EXISTS (SELECT 1 FROM flagged i WHERE i.class = {IP} AND i.patient = ed.patient
        AND i.start_ts >= ed.start_ts AND i.start_ts <= ed.start_ts + INTERVAL 1 DAY) AS hit FROM ed)
SELECT count(*) AS n_ed_visits, count(*) FILTER (WHERE hit) AS n_admitted,
       round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS admission_rate FROM f""")
def q_ed_admission_rate(spark, sf):
    return M.ed_admission_rate(_stays(spark, sf, [B.EMERGENCY, IPC]), B.EMERGENCY, IPC, P, E)


@query("open_stays", f"""WITH {STAYS}
SELECT count(*) AS n_stays, count(*) FILTER (WHERE is_open) AS n_open,
       count(*) FILTER (WHERE NOT is_open) AS n_closed FROM flagged WHERE class = {IP}""")
def q_open_stays(spark, sf):
    return M.open_stays(_stays(spark, sf, [IPC]), [IPC])


@query("reversed_stays", f"""WITH {STAYS}
SELECT count(*) FILTER (WHERE is_reversed) AS n_reversed, count(*) FILTER (WHERE is_complete) AS n_valid
FROM flagged WHERE class = {IP}""")
def q_reversed_stays(spark, sf):
    return M.reversed_stays(_stays(spark, sf, [IPC]), [IPC])


@query("same_day_share", f"""WITH {STAYS}
SELECT count(*) AS n_measured, count(*) FILTER (WHERE {MIDNIGHTS} = 0) AS n_same_day,
       round(avg(CASE WHEN {MIDNIGHTS} = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS same_day_share
FROM flagged WHERE class = {IP} AND is_complete""")
def q_same_day_share(spark, sf):
    return M.same_day_share(_stays(spark, sf, [IPC]), IPC)


@query("los_midnights", f"""WITH {STAYS}
SELECT id, {MIDNIGHTS} AS midnights, {LOS} AS los FROM flagged WHERE class = {IP} AND is_complete""")
def q_los_midnights(spark, sf):
    return M.los_midnights(_stays(spark, sf, [IPC]), IPC)


LOS_DIST_SQL = f"""WITH {STAYS}
SELECT count(*) FILTER (WHERE is_complete) AS n_measured,
       round(avg(CASE WHEN is_complete THEN {LOS} END)::DOUBLE, 6) AS mean_los,
       round(quantile_cont(CASE WHEN is_complete THEN {LOS} END, 0.5)::DOUBLE, 6) AS median_los,
       round(quantile_cont(CASE WHEN is_complete THEN {LOS} END, 0.9)::DOUBLE, 6) AS p90_los,
       round(avg(CASE WHEN is_complete THEN (CASE WHEN {LOS} > 7 THEN 1.0 ELSE 0.0 END) END)::DOUBLE, 9) AS share_over_7,
       count(*) FILTER (WHERE is_open) AS n_open_excluded,
       count(*) FILTER (WHERE is_reversed) AS n_reversed_excluded
FROM flagged WHERE class = {IP}"""


@query("los_distribution", LOS_DIST_SQL)
def q_los_distribution(spark, sf):
    return M.los_distribution(_stays(spark, sf, [IPC]), IPC)


@query("los_calendar_days", f"""WITH {STAYS}
SELECT count(*) AS n_measured, round(avg({MIDNIGHTS} + 1)::DOUBLE, 6) AS mean_calendar_days,
       CAST(sum({MIDNIGHTS} + 1) AS BIGINT) AS total_calendar_days
FROM flagged WHERE class = {IP} AND is_complete""")
def q_los_calendar_days(spark, sf):
    return M.los_calendar_days(_stays(spark, sf, [IPC]), IPC)


@query("los_hours", f"""WITH {STAYS}
SELECT class, count(*) AS n_measured, round(avg({HOURS})::DOUBLE, 6) AS mean_hours,
       round(quantile_cont({HOURS}, 0.5)::DOUBLE, 6) AS median_hours
FROM flagged WHERE class IN ({ED}, {OBS}) AND is_complete GROUP BY class""")
def q_los_hours(spark, sf):
    return M.los_hours(_stays(spark, sf, [B.EMERGENCY, B.OBSERVATION]), [B.EMERGENCY, B.OBSERVATION])


@query("observation_stay", f"""WITH {STAYS}
SELECT count(*) AS n_observation_stays, count(*) FILTER (WHERE is_complete) AS n_measured,
       round(sum(CASE WHEN is_complete THEN {HOURS} END)::DOUBLE, 6) AS total_hours,
       round(avg(CASE WHEN is_complete THEN {HOURS} END)::DOUBLE, 6) AS mean_hours
FROM flagged WHERE class = {OBS} AND {IN_PERIOD}""")
def q_observation_stay(spark, sf):
    return M.observation_stay(_stays(spark, sf, [B.OBSERVATION], PW), [B.OBSERVATION], P, E)


BED_DAYS_CTE = f"""bd AS (
  SELECT organization,
         greatest(date_diff('day', greatest(CAST(start_ts AS DATE), DATE '{P}'),
                            least(CAST(coalesce(stop_ts, TIMESTAMP '{AS_OF}') AS DATE), DATE '{E}')), 0) AS days,
         is_open
  FROM flagged
  WHERE class = {IP} AND NOT is_reversed AND start_ts < {P1}
    AND coalesce(stop_ts, TIMESTAMP '{AS_OF}') > {P0}),
bdg AS (SELECT organization, CAST(sum(days) AS BIGINT) AS bed_days, count(*) AS n_stays,
               count(*) FILTER (WHERE is_open) AS n_open_included FROM bd GROUP BY organization)"""


@query("bed_days", f"WITH {STAYS}, {BED_DAYS_CTE} SELECT * FROM bdg")
def q_bed_days(spark, sf):
    return M.bed_days(_stays(spark, sf, [IPC]), IPC, P, E, AS_OF)


@query("occupancy_rate", f"""WITH {STAYS}, {BED_DAYS_CTE}
SELECT organization, bed_days, CAST({BEDS_PER_ORG} AS INTEGER) AS staffed_beds,
       CAST(date_diff('day', DATE '{P}', DATE '{E}') AS INTEGER) AS days_in_period,
       round(bed_days::DOUBLE / ({BEDS_PER_ORG} * date_diff('day', DATE '{P}', DATE '{E}')), 9) AS occupancy_rate
FROM bdg""")
def q_occupancy_rate(spark, sf):
    # Capacity is an input: a fixed staffed-bed count per organisation of the binding.
    cap = orgs(spark, sf).select(F.col("name").alias("organization")).distinct() \
        .withColumn("staffed_beds", F.lit(BEDS_PER_ORG))
    return M.occupancy_rate(_stays(spark, sf, [IPC]), cap, IPC, P, E, AS_OF)


@query("transfer_pairs", f"WITH {STAYS}, {transfer_pairs_sql()} SELECT * FROM tpairs")
def q_transfer_pairs(spark, sf):
    return M.transfer_pairs(_stays(spark, sf, [IPC]), IPC)


@query("discharge_disposition", f"""WITH {STAYS}, {transfer_pairs_sql()}, {EXCLUSION_TABLES},
d AS (SELECT *, id IN (SELECT from_id FROM tpairs) AS tr, id IN (SELECT id FROM against_advice) AS gone,
        (SELECT death_ts FROM deaths x WHERE x.patient = flagged.patient) AS death_ts FROM flagged
      WHERE class = {IP} AND ((stop_ts >= {P0} AND stop_ts < {P1}) OR is_open))
SELECT CASE WHEN is_open THEN 'open' WHEN is_reversed THEN 'invalid' WHEN death_ts >= start_ts AND death_ts <= stop_ts THEN 'death'
            WHEN gone THEN 'against_advice' WHEN tr THEN 'transfer' ELSE 'home' END AS disposition, count(*) AS n_stays
FROM d GROUP BY 1""")
def q_discharge_disposition(spark, sf):
    return M.discharge_disposition(_stays(spark, sf, [IPC]), IPC, P, E, deaths=B.deaths(spark, sf), against_advice=B.against_advice(spark, sf))


def _exclusions(spark, sf):
    return {"deaths": B.deaths(spark, sf), "against_advice": B.against_advice(spark, sf), "planned": B.planned(spark, sf)}


def _readm(window_days=30, **kw):
    return f"WITH {STAYS}{readmission_sql(window_days, **kw)} SELECT {RATE_COLS}, count(*) FILTER (WHERE x_tail) AS n_tail_excluded FROM idx"


@query("readmission_30day", _readm(30, exclude_transfers=True))
def q_readmission_30day(spark, sf):
    return M.readmission_rate(_stays(spark, sf, [IPC]), IPC, P, E, window_days=30, exclude_transfers=True)


@query("readmission_7day", _readm(7, exclude_transfers=True))
def q_readmission_7day(spark, sf):
    return M.readmission_rate(_stays(spark, sf, [IPC]), IPC, P, E, window_days=7, exclude_transfers=True)


@query("readmission_90day", _readm(90, exclude_transfers=True))
def q_readmission_90day(spark, sf):
    return M.readmission_rate(_stays(spark, sf, [IPC]), IPC, P, E, window_days=90, exclude_transfers=True)


@query("readmission_same_facility", _readm(30, same_facility=True, exclude_transfers=True))
def q_readmission_same_facility(spark, sf):
    return M.readmission_rate(_stays(spark, sf, [IPC]), IPC, P, E, window_days=30,
                              same_facility=True, exclude_transfers=True)


@query("readmission_same_cause", _readm(30, same_cause=True, exclude_transfers=True))
def q_readmission_same_cause(spark, sf):
    return M.readmission_rate(_stays(spark, sf, [IPC]), IPC, P, E, window_days=30,
                              same_cause=True, codes=B.diagnoses(spark, sf), exclude_transfers=True)


@query("readmission_all_exclusions", _readm(30, exclude_transfers=True, all_exclusions=True))
def q_readmission_all_exclusions(spark, sf):
    """With deaths, discharges against advice and planned returns, from their bound tables."""
    return M.readmission_rate(_stays(spark, sf, [IPC]), IPC, P, E, window_days=30, exclude_transfers=True, **_exclusions(spark, sf))


@query("readmission_admission_anchored", _readm(30, anchor="admission", exclude_transfers=True))
def q_readmission_admission_anchored(spark, sf):
    return M.readmission_rate(_stays(spark, sf, [IPC]), IPC, P, E, window_days=30,
                              anchor="admission", exclude_transfers=True)


@query("readmission_by_org", f"WITH {STAYS}{readmission_sql(30, exclude_transfers=True)} SELECT organization, {RATE_COLS} FROM idx GROUP BY organization")
def q_readmission_by_org(spark, sf):
    return M.readmission_by_org(_stays(spark, sf, [IPC]), IPC, P, E, window_days=30, exclude_transfers=True)


@query("exclusion_report", f"""WITH {STAYS}{readmission_sql(30, exclude_transfers=True, all_exclusions=True)}
SELECT count(*) AS n_candidates, count(*) FILTER (WHERE x_open) AS n_open,
       count(*) FILTER (WHERE x_reversed) AS n_reversed, count(*) FILTER (WHERE x_tail) AS n_unobservable_tail,
       count(*) FILTER (WHERE x_transfer) AS n_transfer, count(*) FILTER (WHERE x_death) AS n_death,
       count(*) FILTER (WHERE x_against_advice) AS n_against_advice,
       count(*) FILTER (WHERE eligible) AS n_eligible, 'planned' AS unavailable FROM idx""")
def q_exclusion_report(spark, sf):
    return M.exclusion_report(_stays(spark, sf, [IPC]), IPC, P, E, window_days=30, exclude_transfers=True,
                              deaths=B.deaths(spark, sf), against_advice=B.against_advice(spark, sf))


@query("provider_volume", f"""WITH {STAYS}
SELECT org_id AS provider, count(DISTINCT id) AS n_encounters FROM flagged WHERE class = {IP} AND {IN_PERIOD}
GROUP BY org_id""")
def q_provider_volume(spark, sf):
    return M.provider_volume(_stays(spark, sf, [IPC], PW), "org_id", [IPC], P, E)


@query("org_identity", f"""WITH {SUPPLIER_ORG}
SELECT org_key, name, city, count(*) OVER (PARTITION BY name, city) AS ids_with_identity,
       min(org_key) OVER (PARTITION BY name, city) AS identity_key FROM sup_org""")
def q_org_identity(spark, sf):
    return M.org_identity(orgs(spark, sf))


@query("org_volume_ranking", f"""WITH {STAYS}, {SUPPLIER_ORG},
g AS (SELECT o.name, o.city, count(DISTINCT f.id) AS n_encounters FROM flagged f JOIN sup_org o ON f.org_id = o.org_key
      WHERE f.class = {IP} AND {IN_PERIOD.replace('start_ts', 'f.start_ts')} GROUP BY o.name, o.city)
SELECT name, city, n_encounters, CAST(row_number() OVER (ORDER BY n_encounters DESC, name, city) AS INTEGER) AS rank
FROM g ORDER BY n_encounters DESC, name, city LIMIT 10""")
def q_org_volume_ranking(spark, sf):
    return M.org_volume_ranking(_stays(spark, sf, [IPC], PW), orgs(spark, sf), IPC, P, E, 10)


@query("health_system_rollup", f"""WITH {STAYS}, {SUPPLIER_ORG},
m AS (SELECT org_key AS org_id, 'system-' || CAST(region_key AS VARCHAR) AS system FROM sup_org WHERE region_key <> 0)
SELECT coalesce(m.system, 'unmapped') AS system, count(DISTINCT f.id) AS n_encounters,
       count(DISTINCT f.org_id) AS n_facilities
FROM flagged f LEFT JOIN m ON f.org_id = m.org_id WHERE {IN_PERIOD.replace('start_ts', 'f.start_ts')} GROUP BY 1""")
def q_health_system_rollup(spark, sf):
    # Explicit facility -> system mapping derived from the nation->region links;
    # facilities of region 0 are deliberately left unmapped (kept, not dropped).
    m = orgs(spark, sf).where("region_key <> 0").select(
        F.col("org_key").alias("org_id"),
        F.concat(F.lit("system-"), F.col("region_key").cast("string")).alias("system"))
    return M.health_system_rollup(_stays(spark, sf, None, PW), m, P, E)


@query("patient_dedup", f"""WITH {STAYS},
pk AS (SELECT c_custkey AS patient, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, c_acctbal) AS canonical_patient FROM customer),
j AS (SELECT f.id, f.patient, pk.canonical_patient FROM flagged f LEFT JOIN pk ON f.patient = pk.patient)
SELECT coalesce(canonical_patient, patient) AS canonical_patient, count(DISTINCT patient) AS n_source_ids,
       count(DISTINCT id) AS n_encounters FROM j GROUP BY 1""")
def q_patient_dedup(spark, sf):
    from ..sources.tables import read_table
    # Exact stable key of the binding: (nation, segment, account balance).
    c = read_table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    pats = c.select(F.col("c_custkey").alias("patient"),
                    F.concat_ws("|", "c_nationkey", "c_mktsegment", F.col("c_acctbal").cast("string"))
                     .alias("person_key"))
    return M.patient_dedup(pats, _stays(spark, sf))


@query("payer_normalise", """
WITH p AS (SELECT DISTINCT c_mktsegment AS payer_id, c_mktsegment AS name FROM customer),
k AS (SELECT payer_id, name, upper(trim(name)) AS payer_key FROM p),
d AS (SELECT payer_key, min(name) AS display_name, count(*) AS ids_with_key FROM k GROUP BY payer_key)
SELECT k.payer_id, k.name, k.payer_key, d.display_name, d.ids_with_key FROM k JOIN d USING (payer_key)""")
def q_payer_normalise(spark, sf):
    from ..sources.tables import read_table
    p = read_table(spark, sf, "customer", "c_mktsegment").distinct() \
        .select(F.col("c_mktsegment").alias("payer_id"), F.col("c_mktsegment").alias("name"))
    return M.payer_normalise(p)


@query("payer_mix_encounters", f"""WITH {STAYS},
x AS (SELECT id, coalesce(upper(trim(payer)), 'uninsured') AS payer_key FROM flagged WHERE class = {IP} AND {IN_PERIOD})
SELECT payer_key, count(DISTINCT id) AS n_encounters, (SELECT count(DISTINCT id) FROM x) AS denominator,
       round(count(DISTINCT id)::DOUBLE / (SELECT count(DISTINCT id) FROM x), 9) AS share
FROM x GROUP BY payer_key""")
def q_payer_mix_encounters(spark, sf):
    return M.payer_mix_encounters(_stays(spark, sf, [IPC], PW), None, [IPC], P, E)


@query("payer_mix_patients", f"""WITH {STAYS},
x AS (SELECT patient, coalesce(upper(trim(payer)), 'uninsured') AS payer_key FROM flagged WHERE class = {IP} AND {IN_PERIOD})
SELECT payer_key, count(DISTINCT patient) AS n_patients, (SELECT count(DISTINCT patient) FROM x) AS denominator,
       round(count(DISTINCT patient)::DOUBLE / (SELECT count(DISTINCT patient) FROM x), 9) AS share
FROM x GROUP BY payer_key""")
def q_payer_mix_patients(spark, sf):
    return M.payer_mix_patients(_stays(spark, sf, [IPC], PW), [IPC], P, E)


@query("payer_mix_member_months", f"""
WITH cov AS (SELECT o_custkey AS patient, o_orderpriority AS payer, o_orderdate AS from_ts,
                    lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS to_ts FROM orders),
c AS (SELECT patient, payer, greatest(date_trunc('month', CAST(from_ts AS DATE)), DATE '{P}') AS lo,
             CAST(least(coalesce(to_ts, {P1}), {P1}) AS DATE) AS hi FROM cov
      WHERE from_ts < {P1} AND coalesce(to_ts, {P1}) > {P0}),
m AS (SELECT DISTINCT patient, payer, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi - 1), INTERVAL 1 MONTH)) AS month
      FROM c WHERE hi > lo)
SELECT payer, count(*) AS member_months, count(DISTINCT patient) AS n_members FROM m GROUP BY payer""")
def q_payer_mix_member_months(spark, sf):
    return M.payer_mix_member_months(B.coverage_spans(spark, sf), P, E)


@query("coverage_rate", f"""WITH {STAYS}
SELECT payer, round(sum(covered) / sum(cost), 9) AS coverage_rate, count(*) AS n_encounters
FROM flagged WHERE cost IS NOT NULL AND cost <> 0 GROUP BY payer""")
def q_coverage_rate(spark, sf):
    return M.coverage_rate(_stays(spark, sf))
