"""Registered data-quality injection and check queries (survey 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from . import bindings as B
from ..sources.files import file_list
from ..sources.tables import table_path
from .registry import query

IP = f"'{B.INPATIENT}'"
S = Q.SEED


def _sample_sql(src: str, where: str, seed: int, n: int) -> str:
    return (f"SELECT Id FROM (SELECT DISTINCT Id FROM {src} WHERE {where}) "
            f"ORDER BY md5(Id || '|{seed}'), Id LIMIT {n}")


SPLIT_ID_SQL = ("concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), "
                "substr(h, 21, 12))")

MESSY = f"""WITH
enc0 AS (SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS Id, o.o_orderdate AS START,
  l.l_shipdate AS STOP, CAST(o.o_custkey AS VARCHAR) AS PATIENT, CAST(l.l_suppkey AS VARCHAR) AS ORGANIZATION,
  c.c_mktsegment AS PAYER, o.o_orderpriority AS ENCOUNTERCLASS
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey),
org0 AS (SELECT CAST(s.s_suppkey AS VARCHAR) AS Id, r.r_name AS NAME, n.n_name AS CITY
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
pay0 AS (SELECT Id, upper(left(Id, 1)) || lower(substr(Id, 2)) AS NAME FROM (SELECT DISTINCT c_mktsegment AS Id FROM customer)),
dup0 AS (SELECT Id FROM enc0 GROUP BY Id HAVING count(*) > 1),
d_ids AS ({_sample_sql('enc0', f"ENCOUNTERCLASS = {IP} AND Id NOT IN (SELECT Id FROM dup0)", S, Q.N_DUPLICATES)}),
enc1 AS (SELECT * FROM enc0 UNION ALL SELECT * FROM enc0 WHERE Id IN (SELECT Id FROM d_ids)),
dup1 AS (SELECT Id FROM enc1 GROUP BY Id HAVING count(*) > 1),
o_ids AS ({_sample_sql('enc1', f"ENCOUNTERCLASS = {IP} AND STOP IS NOT NULL AND START >= TIMESTAMP '{B.OPEN_FROM}' AND Id NOT IN (SELECT Id FROM dup1)", S + 1, Q.N_OPEN)}),
enc2 AS (SELECT * REPLACE (CASE WHEN Id IN (SELECT Id FROM o_ids) THEN NULL ELSE STOP END AS STOP) FROM enc1),
r_ids AS ({_sample_sql('enc2', f"ENCOUNTERCLASS = {IP} AND STOP IS NOT NULL AND START < TIMESTAMP '{B.OPEN_FROM}' AND Id NOT IN (SELECT Id FROM dup1)", S + 2, Q.N_REVERSED)}),
enc3 AS (SELECT * REPLACE (CASE WHEN Id IN (SELECT Id FROM r_ids) THEN START - INTERVAL 2 DAY ELSE STOP END AS STOP) FROM enc2),
top_payer AS (SELECT PAYER AS Id FROM enc3 WHERE ENCOUNTERCLASS = {IP} AND START >= TIMESTAMP '{B.PERIOD_START}'
  AND START < TIMESTAMP '{B.PERIOD_END}' GROUP BY PAYER ORDER BY count(*) DESC, PAYER LIMIT 1),
variant AS (SELECT orig_id, {SPLIT_ID_SQL} AS Id, NAME FROM (
  SELECT p.Id AS orig_id, sha1('{Q.SPLIT_PREFIX}' || p.Id) AS h, upper(p.NAME) || '  ' AS NAME
  FROM pay0 p WHERE p.Id IN (SELECT Id FROM top_payer))),
pay1 AS (SELECT Id, NAME FROM pay0 UNION ALL SELECT Id, NAME FROM variant),
enc4x AS (SELECT e.*, v.Id IS NOT NULL AND e.START >= TIMESTAMP '{B.SPLIT_DATE}' AS hit, v.Id AS new_id
  FROM enc3 e LEFT JOIN variant v ON e.PAYER = v.orig_id),
split_ids AS (SELECT DISTINCT Id FROM enc4x WHERE hit),
enc4 AS (SELECT * EXCLUDE (hit, new_id) REPLACE (CASE WHEN hit THEN new_id ELSE PAYER END AS PAYER) FROM enc4x),
coll1 AS (SELECT upper(trim(NAME)) AS k FROM pay1 GROUP BY 1 HAVING count(*) > 1),
c_ids AS ({_sample_sql('pay1', "NAME IS NOT NULL AND NAME <> '' AND upper(trim(NAME)) NOT IN (SELECT k FROM coll1)", S + 3, Q.N_PAYER_CASING)}),
pay2 AS (SELECT Id, CASE WHEN Id IN (SELECT Id FROM c_ids) THEN upper(NAME) || '  ' ELSE NAME END AS NAME FROM pay1),
coll2 AS (SELECT upper(trim(NAME)) AS k FROM pay2 GROUP BY 1 HAVING count(*) > 1),
top_org AS (SELECT ORGANIZATION AS Id FROM enc4 WHERE ENCOUNTERCLASS = {IP} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
old AS (SELECT Id AS orig_id, Id || '{Q.MERGED_ORG_SUFFIX}' AS Id, NAME, CITY FROM org0 WHERE Id IN (SELECT Id FROM top_org)),
org1 AS (SELECT Id, NAME, CITY FROM org0 UNION ALL SELECT Id, NAME, CITY FROM old),
enc5x AS (SELECT e.*, o.Id IS NOT NULL AND e.START < TIMESTAMP '{B.SPLIT_DATE}' AS hit, o.Id AS old_id
  FROM enc4 e LEFT JOIN old o ON e.ORGANIZATION = o.orig_id),
merge_ids AS (SELECT DISTINCT Id FROM enc5x WHERE hit),
enc5 AS (SELECT * EXCLUDE (hit, old_id) REPLACE (CASE WHEN hit THEN old_id ELSE ORGANIZATION END AS ORGANIZATION) FROM enc5x),
rec AS (
  SELECT 'duplicate_encounters' AS injection, 'some inpatient rows are stored twice, so a plain row count is too high' AS description,
    {Q.N_DUPLICATES}::BIGINT AS intended, ((SELECT count(*) FROM dup1) - (SELECT count(*) FROM dup0))::BIGINT AS observed,
    'ids with two or more rows' AS unit
  UNION ALL SELECT 'open_stays', 'inpatient stays that have no end yet', {Q.N_OPEN},
    (SELECT count(*) FILTER (WHERE STOP IS NULL) FROM enc2) - (SELECT count(*) FILTER (WHERE STOP IS NULL) FROM enc1),
    'stays, each id once (stored copies are never picked)'
  UNION ALL SELECT 'reversed_stays', 'stays that end before they begin; interval measures leave them out', {Q.N_REVERSED},
    (SELECT count(*) FILTER (WHERE STOP < START) FROM enc3) - (SELECT count(*) FILTER (WHERE STOP < START) FROM enc2),
    'stays, each id once (stored copies are never picked)'
  UNION ALL SELECT 'payer_split', 'the payer with most stays has a second id from some day on, under the same name in capitals and with blanks after it',
    1, (SELECT count(*) FROM pay1 WHERE Id IN (SELECT Id FROM variant)), 'payers that now have two ids'
  UNION ALL SELECT 'payer_casing', 'names of other payers in capitals with blanks after them; no result depends on these',
    {Q.N_PAYER_CASING}, (SELECT count(*) FROM pay2 WHERE NAME <> rtrim(NAME) AND upper(trim(NAME)) NOT IN (SELECT k FROM coll2)),
    'payer names written differently under one id'
  UNION ALL SELECT 'merged_organization', 'the organisation with most stays got a new id within the year, so grouping by id halves it',
    1, (SELECT count(*) FROM org1 WHERE Id LIKE '%{Q.MERGED_ORG_SUFFIX}'), 'organisations that now have two ids')
"""


_BUILT: dict = {}


def _snapshot(spark, sf) -> tuple:
    """The files that the warehouse is bound to, with their size and time; no row is read."""
    return tuple(sorted(tuple(map(str, r)) for t in ("orders", "lineitem", "customer", "supplier", "nation", "region", "part")
                        for r in file_list(spark, table_path(sf, t)).collect()))


def injected(spark, sf):
    """The injected warehouse, built once per Spark application and state of the tables.

    The snapshots are written once (Parquet in the shared checkpoint folder) and every
    later question or check reads them."""
    key = (spark.sparkContext.applicationId, sf, _snapshot(spark, sf))
    if key not in _BUILT:
        _BUILT[key] = Q.messify(B.warehouse(spark, sf), B.recipe())
    return _BUILT[key]


def _run(spark, sf, upto=None):
    if upto is None:
        return injected(spark, sf)
    return Q.messify(B.warehouse(spark, sf), B.recipe(), upto)


def _rec_query(key, inj):
    @query(key, MESSY + f"SELECT * FROM rec WHERE injection = '{inj}'")
    def q(spark, sf):
        _, _, recs = _run(spark, sf, inj)
        return recs[inj]
    q.__name__ = f"q_{key}"
    return q


for _k, _i in (("inject_duplicates", "duplicate_encounters"), ("inject_open", "open_stays"),
               ("inject_reversed", "reversed_stays"), ("inject_payer_split", "payer_split"),
               ("inject_payer_casing", "payer_casing"), ("inject_merged_org", "merged_organization")):
    _rec_query(_k, _i)


@query("verify_injections", MESSY + "SELECT *, intended = observed AS ok FROM rec")
def q_verify_injections(spark, sf):
    _, _, recs = _run(spark, sf)
    return Q.verify_injections(recs)


@query("not_duplicated_filter", MESSY + f"""SELECT Id FROM enc1 WHERE ENCOUNTERCLASS = {IP}
  AND Id NOT IN (SELECT Id FROM dup1)""")
def q_not_duplicated_filter(spark, sf):
    wh, _, _ = _run(spark, sf, "duplicate_encounters")
    return Q.not_duplicated(wh.encounters).where(F.col("ENCOUNTERCLASS") == B.INPATIENT).select("Id")


@query("check_dup_visible", MESSY + f"""SELECT count(*) AS n_rows, count(DISTINCT Id) AS n_encounters,
  count(*) > count(DISTINCT Id) AS visible FROM enc5 WHERE ENCOUNTERCLASS = {IP}
  AND START >= TIMESTAMP '{B.PERIOD_START}' AND START < TIMESTAMP '{B.PERIOD_END}'""")
def q_check_dup_visible(spark, sf):
    wh, _, _ = _run(spark, sf)
    return Q.check_dup_visible(wh.encounters, B.recipe())


_PAYER_COUNTS = f"""pc AS (SELECT e.*, p.NAME FROM enc5 e JOIN pay2 p ON p.Id = e.PAYER WHERE e.ENCOUNTERCLASS = {IP}
  AND e.START >= TIMESTAMP '{B.PERIOD_START}' AND e.START < TIMESTAMP '{B.PERIOD_END}'),
raw AS (SELECT NAME AS payer, count(*) AS n FROM pc GROUP BY 1),
nrm AS (SELECT upper(trim(NAME)) AS payer, count(*) AS n FROM pc GROUP BY 1)"""


@query("check_split_visible", MESSY + f""", {_PAYER_COUNTS}
SELECT *, 'raw' AS grouping FROM (SELECT * FROM raw EXCEPT ALL SELECT * FROM nrm)
UNION ALL SELECT *, 'normalised' FROM (SELECT * FROM nrm EXCEPT ALL SELECT * FROM raw)""")
def q_check_split_visible(spark, sf):
    wh, _, _ = _run(spark, sf)
    return Q.check_split_visible(wh, B.recipe())


@query("check_distractors", MESSY + """SELECT count(*) AS n_colliding_keys, count(*) = 1 AS ok FROM coll2""")
def q_check_distractors(spark, sf):
    wh, _, _ = _run(spark, sf)
    return Q.check_distractors(wh)


@query("check_org_visible", MESSY + f"""SELECT ORGANIZATION, count(*) AS n_rows FROM enc5
WHERE ENCOUNTERCLASS = {IP} AND START >= TIMESTAMP '{B.PERIOD_START}' AND START < TIMESTAMP '{B.PERIOD_END}'
  AND (ORGANIZATION IN (SELECT Id FROM old) OR ORGANIZATION IN (SELECT orig_id FROM old)) GROUP BY 1""")
def q_check_org_visible(spark, sf):
    wh, _, _ = _run(spark, sf)
    return Q.check_org_visible(wh, B.recipe())


@query("refuse_second_run", "WITH e AS (SELECT l_shipdate AS STOP FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
       "JOIN customer c ON o.o_custkey = c.c_custkey) SELECT count(*) FILTER (WHERE STOP IS NULL) AS n_open, true AS fresh FROM e")
def q_refuse_second_run(spark, sf):
    return Q.refuse_second_run(B.warehouse(spark, sf))


_SETS = ("duplicate_encounters", "open_stays", "reversed_stays", "payer_split", "merged_organization")
_SET_CTE = {"duplicate_encounters": "d_ids", "open_stays": "o_ids", "reversed_stays": "r_ids",
            "payer_split": "split_ids", "merged_organization": "merge_ids"}


@query("injection_overlap_matrix", MESSY + " UNION ALL ".join(
    f"SELECT '{a}' AS set_a, '{b}' AS set_b, (SELECT count(*) FROM {_SET_CTE[a]} WHERE Id IN (SELECT Id FROM {_SET_CTE[b]})) AS n_both"
    for i, a in enumerate(_SETS) for b in _SETS[i + 1:]))
def q_injection_overlap_matrix(spark, sf):
    _, touched, _ = _run(spark, sf)
    return Q.injection_overlap_matrix(touched)


@query("sample_determinism", MESSY + "SELECT Id, true AS in_first, true AS in_second FROM d_ids")
def q_sample_determinism(spark, sf):
    """The same seed selects the same ids whatever the input partitioning and order."""
    wh = B.warehouse(spark, sf)
    pool = Q.not_duplicated(wh.encounters).where(F.col("ENCOUNTERCLASS") == B.INPATIENT)
    a = Q._sample(pool, Q.SEED, Q.N_DUPLICATES).withColumn("in_first", F.lit(True))
    b = Q._sample(pool.repartition(7, "PATIENT").sortWithinPartitions(F.rand(1)), Q.SEED, Q.N_DUPLICATES) \
        .withColumn("in_second", F.lit(True))
    return a.join(b, "Id", "full").select("Id", F.coalesce("in_first", F.lit(False)).alias("in_first"),
                                          F.coalesce("in_second", F.lit(False)).alias("in_second"))


@query("win_canonical_name", MESSY + """SELECT payer_key, NAME AS display_name, n_ids FROM (
  SELECT upper(trim(NAME)) AS payer_key, NAME, count(*) OVER (PARTITION BY upper(trim(NAME))) AS n_ids,
  row_number() OVER (PARTITION BY upper(trim(NAME)) ORDER BY NAME, Id) AS rn FROM pay2) WHERE rn = 1""")
def q_win_canonical_name(spark, sf):
    """One display spelling per normalised payer name of the injected payers
    (smallest spelling, then id), with the number of ids sharing the key."""
    from pyspark.sql import Window
    from ..functions.exprs import normalise_name
    wh, _, _ = _run(spark, sf)
    p = wh.payers.withColumn("payer_key", normalise_name("NAME"))
    w = Window.partitionBy("payer_key")
    return (p.withColumn("n_ids", F.count("*").over(w))
             .withColumn("_rn", F.row_number().over(w.orderBy("NAME", "Id"))).where("_rn = 1")
             .select("payer_key", F.col("NAME").alias("display_name"), "n_ids"))
