"""SQL building blocks of the DuckDB oracle: the same role bindings as
``plans/bindings.py``, written as CTEs over the pre-registered driver views."""

from __future__ import annotations

from .bindings import EMERGENCY, INPATIENT, OBSERVATION, PERIOD_END, PERIOD_START

STAYS_RAW = f"""stays_raw AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS id,
         l.l_orderkey AS okey, l.l_linenumber AS lnum, o.o_orderdate AS start_ts,
         CASE WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'O' THEN NULL ELSE l.l_shipdate END AS stop_ts,
         o.o_custkey AS patient, r.r_name AS organization, l.l_suppkey AS org_id,
         o.o_orderpriority AS class, c.c_mktsegment AS payer, l.l_extendedprice AS cost,
         l.l_extendedprice * (1 - l.l_discount) AS covered, l.l_returnflag AS cause
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN customer c ON o.o_custkey = c.c_custkey)"""

DEDUP_ORDER = ("stop_ts ASC NULLS LAST, organization ASC NULLS LAST, cost ASC NULLS LAST, "
               "org_id ASC NULLS LAST, covered ASC NULLS LAST, cause ASC NULLS LAST")

STAYS = f"""{STAYS_RAW},
stays AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY okey, lnum ORDER BY {DEDUP_ORDER}) AS rn
    FROM stays_raw) WHERE rn = 1),
flagged AS (
  SELECT *, stop_ts IS NULL AS is_open,
         coalesce(stop_ts < start_ts, false) AS is_reversed,
         stop_ts IS NOT NULL AND NOT coalesce(stop_ts < start_ts, false) AS is_complete
  FROM stays)"""

P0 = f"TIMESTAMP '{PERIOD_START}'"
P1 = f"TIMESTAMP '{PERIOD_END}'"
IP = f"'{INPATIENT}'"
ED = f"'{EMERGENCY}'"
OBS = f"'{OBSERVATION}'"
IN_PERIOD = f"start_ts >= {P0} AND start_ts < {P1}"
MIDNIGHTS = "date_diff('day', CAST(start_ts AS DATE), CAST(stop_ts AS DATE))"
LOS = f"least({MIDNIGHTS}, 365)"
HOURS = "(epoch_us(stop_ts) - epoch_us(start_ts)) / 3600000000.0"

SUPPLIER_ORG = """sup_org AS (
  SELECT s.s_suppkey AS org_key, r.r_name AS name, n.n_name AS city, n.n_regionkey AS region_key
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


_LINE_ID = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
DIAGNOSES = f"""codes AS (SELECT {_LINE_ID} AS id, 'P' || CAST(l_partkey % 12 AS VARCHAR) AS code FROM lineitem
  UNION SELECT {_LINE_ID}, 'R' || l_returnflag FROM lineitem WHERE l_returnflag <> 'N')"""
EXCLUSION_TABLES = f"""deaths AS (SELECT o_custkey AS patient, max(l_shipdate) AS death_ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 500 AND o_orderpriority = '{INPATIENT}'
    AND l_shipdate >= TIMESTAMP '{PERIOD_START}' AND l_shipdate < TIMESTAMP '{PERIOD_END}' GROUP BY 1),
against_advice AS (SELECT DISTINCT {_LINE_ID} AS id FROM lineitem WHERE l_tax >= 0.08),
planned AS (SELECT DISTINCT {_LINE_ID} AS id FROM lineitem WHERE l_discount = 0)"""


def transfer_pairs_sql(gap_days: int = 1) -> str:
    return f"""tpairs AS (
  SELECT a.id AS from_id, b.id AS to_id, a.patient, a.organization AS from_org, b.organization AS to_org
  FROM flagged a JOIN flagged b
    ON a.patient = b.patient AND a.organization <> b.organization
   AND b.start_ts >= a.stop_ts AND b.start_ts <= a.stop_ts + INTERVAL {gap_days} DAY AND a.id <> b.id
  WHERE a.class = {IP} AND a.is_complete AND b.class = {IP} AND NOT b.is_reversed)"""


def readmission_sql(window_days: int = 30, anchor: str = "discharge", same_facility=False,
                    same_cause=False, exclude_transfers=False, all_exclusions=False) -> str:
    """CTEs ``idx`` (one row per candidate index with flags and ``readmitted``)."""
    anchor_col = "stop_ts" if anchor == "discharge" else "start_ts"
    extra = ""
    if same_facility:
        extra += " AND fu.organization = e.organization"
    if same_cause:
        extra += " AND EXISTS (SELECT 1 FROM codes c1 JOIN codes c2 ON c1.code = c2.code WHERE c1.id = e.id AND c2.id = fu.id)"
    if all_exclusions:
        extra += " AND fu.id NOT IN (SELECT id FROM planned)"
    died = "coalesce((SELECT death_ts FROM deaths d WHERE d.patient = flagged.patient) <= stop_ts, false)" if all_exclusions else "false"
    left_ = "id IN (SELECT id FROM against_advice)" if all_exclusions else "false"
    tr = (f", {transfer_pairs_sql()}" if exclude_transfers else "")
    x_tr = ("coalesce(id IN (SELECT from_id FROM tpairs), false)" if exclude_transfers else "false")
    tables = f", {DIAGNOSES}" if same_cause else ""
    tables += f", {EXCLUSION_TABLES}" if all_exclusions else ""
    return f"""{tr}{tables},
cand AS (
  SELECT *, {anchor_col} AS anchor_ts, is_open AS x_open, is_reversed AS x_reversed,
         coalesce(stop_ts > {P1} - INTERVAL {window_days} DAY, false) AS x_tail,
         {x_tr} AS x_transfer, {died} AS x_death, {left_} AS x_against_advice
  FROM flagged
  WHERE class = {IP} AND ((stop_ts >= {P0} AND stop_ts < {P1}) OR is_open)),
cand2 AS (SELECT *, NOT (x_open OR x_reversed OR x_tail OR x_transfer OR x_death OR x_against_advice) AS eligible FROM cand),
idx AS (
  SELECT e.*, e.eligible AND EXISTS (
      SELECT 1 FROM flagged fu
      WHERE fu.class = {IP} AND NOT fu.is_reversed AND fu.patient = e.patient AND fu.id <> e.id
        AND fu.start_ts > e.anchor_ts AND fu.start_ts <= e.anchor_ts + INTERVAL {window_days} DAY{extra}
  ) AS readmitted
  FROM cand2 e)"""


RATE_COLS = """count(*) FILTER (WHERE eligible) AS n_eligible,
       count(*) FILTER (WHERE readmitted) AS n_readmitted,
       round(CAST(count(*) FILTER (WHERE readmitted) AS DOUBLE)
             / nullif(CAST(count(*) FILTER (WHERE eligible) AS DOUBLE), 0), 9) AS readmission_rate"""
