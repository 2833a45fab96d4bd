"""Registered relational-core queries (survey 2.3-2.8) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import RESULT_ROW_CAP
from ..operators import metrics as M
from ..operators import relational as R
from ..sources.tables import read_table
from . import bindings as B
from .registry import query
from .sqlparts import IP, P0, P1, STAYS

SEED = B.SAMPLE_SEED
T = read_table


# --- 2.3 projections and filters --------------------------------------------------------

@query("project_star", "SELECT * FROM orders")
def q_project_star(spark, sf):
    return T(spark, sf, "orders").select("*")


@query("project_replace", """SELECT c_custkey + 1000000000 AS c_custkey, upper(c_name) || '  ' AS c_name,
  * EXCLUDE (c_custkey, c_name) FROM customer""")
def q_project_replace(spark, sf):
    c = T(spark, sf, "customer")
    return R.project_replace(c, {"c_custkey": F.col("c_custkey") + 1_000_000_000,
                                 "c_name": F.concat(F.upper("c_name"), F.lit("  "))})


@query("project_explicit_copy", """SELECT CAST(s_suppkey AS VARCHAR) || '-OLD' AS s_suppkey, s_name, s_nationkey, s_acctbal
FROM supplier""")
def q_project_explicit_copy(spark, sf):
    s = T(spark, sf, "supplier")
    return R.project_explicit_copy(s, "s_suppkey", F.concat(F.col("s_suppkey").cast("string"), F.lit("-OLD")))


@query("filter_eq", f"SELECT * FROM orders WHERE o_orderpriority = {IP}")
def q_filter_eq(spark, sf):
    return T(spark, sf, "orders").where(F.col("o_orderpriority") == B.INPATIENT)


@query("filter_halfopen_range", f"SELECT * FROM orders WHERE o_orderdate >= {P0} AND o_orderdate < {P1}")
def q_filter_halfopen_range(spark, sf):
    return T(spark, sf, "orders").where(M.in_window("o_orderdate", B.PERIOD_START, B.PERIOD_END))


@query("filter_year", "SELECT * FROM orders WHERE year(o_orderdate) = 1998")
def q_filter_year(spark, sf):
    return T(spark, sf, "orders").where(R.year_window("o_orderdate", 1998))


@query("filter_null", f"WITH {STAYS} SELECT id, start_ts FROM flagged WHERE stop_ts IS NULL")
def q_filter_null(spark, sf):
    return B.stays(spark, sf).where(F.col("stop_ts").isNull()).select("id", "start_ts")


@query("filter_columns", f"WITH {STAYS} SELECT id, start_ts, stop_ts FROM flagged WHERE stop_ts < start_ts")
def q_filter_columns(spark, sf):
    return B.stays(spark, sf).where(F.col("stop_ts") < F.col("start_ts")).select("id", "start_ts", "stop_ts")


@query("filter_neq_expr", "SELECT doc_id FROM documents WHERE text <> rtrim(text, '.') AND text <> ''")
def q_filter_neq_expr(spark, sf):
    # texts that end in a full stop: the column differs from its right-trimmed self
    d = T(spark, sf, "documents", "doc_id", "text")
    return d.where((F.col("text") != F.rtrim("text", F.lit("."))) & (F.col("text") != "")).select("doc_id")


@query("filter_like_suffix", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '%-URGENT'")
def q_filter_like_suffix(spark, sf):
    return T(spark, sf, "orders", "o_orderkey", "o_orderpriority").where(F.col("o_orderpriority").endswith("-URGENT"))


@query("filter_in_subquery", """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_filter_in_subquery(spark, sf):
    o = T(spark, sf, "orders", "o_orderkey", "o_custkey")
    c = T(spark, sf, "customer", "c_custkey", "c_mktsegment").where(F.col("c_mktsegment") == "BUILDING")
    return R.filter_in(o, "o_custkey", c, "c_custkey")


@query("filter_not_in_subquery", """SELECT o_orderkey FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def q_filter_not_in_subquery(spark, sf):
    o = T(spark, sf, "orders", "o_orderkey")
    rep = R.having_count(T(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 2)
    return R.filter_not_in(o, "o_orderkey", rep, "l_orderkey")


@query("conditional_update", f"""SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderpriority = {IP} AND o_orderdate >= {P0} THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def q_conditional_update(spark, sf):
    o = T(spark, sf, "orders")
    cond = (F.col("o_orderpriority") == B.INPATIENT) & (F.col("o_orderdate") >= F.lit(B.PERIOD_START).cast("timestamp_ntz"))
    return R.conditional_update(o, "o_orderstatus", F.lit("X"), cond)


# --- 2.4 joins ---------------------------------------------------------------------------

@query("join_fact_payer", """SELECT c.c_mktsegment AS payer, count(*) AS n_orders
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1""")
def q_join_fact_payer(spark, sf):
    o = T(spark, sf, "orders", "o_custkey")
    c = T(spark, sf, "customer", "c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("payer")) \
        .agg(F.count("*").alias("n_orders"))


@query("join_fact_org", """SELECT s.s_nationkey AS nation, count(*) AS n_lines
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1""")
def q_join_fact_org(spark, sf):
    li = T(spark, sf, "lineitem", "l_suppkey")
    s = T(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    return li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("nation")) \
        .agg(F.count("*").alias("n_lines"))


@query("join_fact_patient", """SELECT o.o_orderkey, c.c_name, c.c_acctbal
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_join_fact_patient(spark, sf):
    o = T(spark, sf, "orders", "o_orderkey", "o_custkey")
    c = T(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_acctbal")


@query("join_semi", f"""SELECT c_custkey FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = {IP})""")
def q_join_semi(spark, sf):
    c = T(spark, sf, "customer", "c_custkey")
    o = T(spark, sf, "orders", "o_custkey", "o_orderpriority").where(F.col("o_orderpriority") == B.INPATIENT)
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi")


@query("join_anti", """SELECT doc_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_join_anti(spark, sf):
    d = T(spark, sf, "documents", "doc_id")
    lab = T(spark, sf, "labels", "doc_id")
    return d.join(lab, "doc_id", "left_anti")


@query("join_range_followup", f"""WITH {STAYS}
SELECT e.id AS index_id, fu.id AS followup_id
FROM flagged e JOIN flagged fu ON fu.patient = e.patient AND fu.id <> e.id
 AND fu.start_ts > e.stop_ts AND fu.start_ts <= e.stop_ts + INTERVAL 30 DAY
WHERE e.class = {IP} AND e.is_complete AND fu.class = {IP} AND NOT fu.is_reversed""")
def q_join_range_followup(spark, sf):
    from ..functions.exprs import day_bucket, window_buckets
    s = M.with_flags(B.stays(spark, sf, [B.INPATIENT]))
    e = s.where("is_complete").select(F.col("id").alias("index_id"), "patient", F.col("stop_ts").alias("stop"),
                                      F.explode(window_buckets("stop_ts", 30, 30)).alias("b"))
    fu = s.where(~F.col("is_reversed")).select(F.col("id").alias("followup_id"), F.col("patient").alias("p2"),
                                               F.col("start_ts").alias("s2"), day_bucket("start_ts", 30).alias("b2"))
    cond = ((e.patient == fu.p2) & (e.b == fu.b2) & (e.index_id != fu.followup_id) & (fu.s2 > e.stop)
            & (fu.s2 <= e.stop + F.expr("INTERVAL 30 DAYS")))
    return e.join(fu, cond).select("index_id", "followup_id")


@query("join_adjacency", f"""WITH {STAYS}
SELECT a.id AS from_id, b.id AS to_id
FROM flagged a JOIN flagged b ON a.patient = b.patient AND a.org_id <> b.org_id AND a.id <> b.id
 AND b.start_ts >= a.stop_ts AND b.start_ts <= a.stop_ts + INTERVAL 1 DAY
WHERE a.class = {IP} AND a.is_complete AND b.class = {IP} AND NOT b.is_reversed""")
def q_join_adjacency(spark, sf):
    s = B.stays(spark, sf, [B.INPATIENT]).withColumn("organization", F.col("org_id"))
    return M.transfer_pairs(s, B.INPATIENT, 1).select("from_id", "to_id")


@query("join_event_to_event", f"""WITH {STAYS}
SELECT e.id AS ed_id, i.id AS inpatient_id
FROM flagged e JOIN flagged i ON i.patient = e.patient AND i.start_ts >= e.start_ts
 AND i.start_ts <= e.start_ts + INTERVAL 1 DAY
WHERE e.class = '{B.EMERGENCY}' AND i.class = {IP}""")
def q_join_event_to_event(spark, sf):
    from ..functions.exprs import day_bucket, window_buckets
    s = B.stays(spark, sf, [B.EMERGENCY, B.INPATIENT])
    e = s.where(F.col("class") == B.EMERGENCY).select(F.col("id").alias("ed_id"), "patient", "start_ts",
                                                      F.explode(window_buckets("start_ts", 1, 1)).alias("b"))
    i = s.where(F.col("class") == B.INPATIENT).select(F.col("id").alias("inpatient_id"),
                                                     F.col("patient").alias("p2"), F.col("start_ts").alias("s2"),
                                                     day_bucket("start_ts", 1).alias("b2"))
    cond = ((e.patient == i.p2) & (e.b == i.b2) & (i.s2 >= e.start_ts)
            & (i.s2 <= e.start_ts + F.expr("INTERVAL 1 DAYS")))
    return e.join(i, cond).select("ed_id", "inpatient_id")


@query("join_missing_dimension", """SELECT coalesce(CAST(l.quality AS VARCHAR), 'unlabelled') AS quality,
  count(*) AS n_documents FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def q_join_missing_dimension(spark, sf):
    d = T(spark, sf, "documents", "doc_id")
    lab = T(spark, sf, "labels", "doc_id", "quality")
    return d.join(lab, "doc_id", "left").groupBy(
        F.coalesce(F.col("quality").cast("string"), F.lit("unlabelled")).alias("quality")) \
        .agg(F.count("*").alias("n_documents"))


# --- 2.5 aggregates -----------------------------------------------------------------------

@query("agg_count", "SELECT count(*) AS n_rows FROM lineitem")
def q_agg_count(spark, sf):
    return T(spark, sf, "lineitem").agg(F.count("*").alias("n_rows"))


@query("agg_count_distinct", """SELECT count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_suppkey) AS n_suppliers
FROM lineitem""")
def q_agg_count_distinct(spark, sf):
    li = T(spark, sf, "lineitem", "l_orderkey", "l_suppkey")
    return li.agg(F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("agg_group", """SELECT l_returnflag, l_linestatus, count(*) AS n_lines, round(sum(l_quantity), 4) AS sum_qty,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY 1, 2""")
def q_agg_group(spark, sf):
    li = T(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("agg_having", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""")
def q_agg_having(spark, sf):
    return R.having_count(T(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 2)


@query("agg_of_agg", """SELECT count(*) AS n_repeated_ids FROM (
  SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)""")
def q_agg_of_agg(spark, sf):
    return R.having_count(T(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 2) \
        .agg(F.count("*").alias("n_repeated_ids"))


@query("agg_minmax", "SELECT min(o_orderdate) AS min_start, max(o_orderdate) AS max_start FROM orders")
def q_agg_minmax(spark, sf):
    return T(spark, sf, "orders", "o_orderdate").agg(F.min("o_orderdate").alias("min_start"),
                                                     F.max("o_orderdate").alias("max_start"))


@query("agg_sum_coalesce", """SELECT l_returnflag,
  CAST(coalesce(sum(CAST(l_partkey AS DECIMAL(38,0))) FILTER (WHERE l_discount > 0.5), 0) AS DECIMAL(38,0)) AS s_none,
  CAST(coalesce(sum(CAST(l_partkey AS DECIMAL(38,0))), 0) AS DECIMAL(38,0)) AS s_all
FROM lineitem GROUP BY 1""")
def q_agg_sum_coalesce(spark, sf):
    li = T(spark, sf, "lineitem", "l_returnflag", "l_partkey", "l_discount")
    v = F.col("l_partkey").cast("decimal(38,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    return li.groupBy("l_returnflag").agg(
        F.coalesce(F.sum(F.when(F.col("l_discount") > 0.5, v)), zero).cast("decimal(38,0)").alias("s_none"),
        F.coalesce(F.sum(v), zero).cast("decimal(38,0)").alias("s_all"))


@query("agg_percentile", """SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) AS median_price,
  round(quantile_cont(o_totalprice, 0.9), 6) AS p90_price FROM orders GROUP BY 1""")
def q_agg_percentile(spark, sf):
    o = T(spark, sf, "orders", "o_orderpriority", "o_totalprice")
    return R.exact_percentiles(o, ["o_orderpriority"], "o_totalprice", {"median_price": 0.5, "p90_price": 0.9})


@query("agg_share", """SELECT round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS share_discounted
FROM lineitem WHERE l_discount IS NOT NULL""")
def q_agg_share(spark, sf):
    li = T(spark, sf, "lineitem", "l_discount").where(F.col("l_discount").isNotNull())
    return li.agg(F.round(F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0).cast("double")), 9)
                  .alias("share_discounted"))


@query("agg_ratio_of_sums", """SELECT round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 9) AS covered_ratio
FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_extendedprice <> 0""")
def q_agg_ratio_of_sums(spark, sf):
    li = T(spark, sf, "lineitem", "l_extendedprice", "l_discount").where(
        F.col("l_extendedprice").isNotNull() & (F.col("l_extendedprice") != 0))
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_extendedprice"), 9)
                  .alias("covered_ratio"))


@query("agg_share_of_total", """SELECT o_orderpriority, count(*) AS n_orders,
  round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1""")
def q_agg_share_of_total(spark, sf):
    g = T(spark, sf, "orders", "o_orderpriority").groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"))
    return R.share_of_total(g, "n_orders")


@query("agg_latency_quantiles", """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def q_agg_latency_quantiles(spark, sf):
    e = T(spark, sf, "events", "event_type", "value")
    return R.exact_percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


# --- 2.6 windows ----------------------------------------------------------------------------

LINE_ORDER_SQL = ("l_shipdate, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, "
                  "l_returnflag, l_linestatus")


@query("win_dedupe", f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY {LINE_ORDER_SQL}) AS rn FROM lineitem) WHERE rn = 1""")
def q_win_dedupe(spark, sf):
    li = T(spark, sf, "lineitem")
    return R.dedupe_by(li, ["l_orderkey", "l_linenumber"], LINE_ORDER_SQL.split(", "))


@query("win_step_order", """SELECT user_id AS run_id, event_id, CAST(row_number() OVER (PARTITION BY user_id
  ORDER BY ts, event_id) AS INTEGER) AS step FROM events""")
def q_win_step_order(spark, sf):
    e = T(spark, sf, "events", "user_id", "event_id", "ts")
    return R.step_order(e, "user_id", ["ts", "event_id"]).select(
        F.col("user_id").alias("run_id"), "event_id", "step")


@query("win_repeat", """SELECT user_id AS run_id, event_id FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS occurrence FROM events) WHERE occurrence > 1""")
def q_win_repeat(spark, sf):
    e = T(spark, sf, "events", "user_id", "event_id", "ts", "event_type", "props")
    return R.repeats(e, "user_id", ["event_type", "props"], ["ts", "event_id"]).select(
        F.col("user_id").alias("run_id"), "event_id")


@query("win_loop_window", """WITH s AS (SELECT user_id, event_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id AS run_id, event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY step
  RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS repeats_in_window FROM s""")
def q_win_loop_window(spark, sf):
    e = T(spark, sf, "events", "user_id", "event_id", "ts", "event_type")
    s = R.step_order(e, "user_id", ["ts", "event_id"])
    return R.loop_window(s, "user_id", ["event_type"], "step", 5).select(
        F.col("user_id").alias("run_id"), "event_id", "repeats_in_window")


@query("win_total", """SELECT event_type, count(*) AS n_events,
  round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1""")
def q_win_total(spark, sf):
    g = T(spark, sf, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n_events"))
    return R.share_of_total(g, "n_events")


# --- 2.7 sorts, limits ----------------------------------------------------------------------

@query("sort_desc_tiebreak", """SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey""")
def q_sort_desc_tiebreak(spark, sf):
    return T(spark, sf, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n")) \
        .orderBy(F.desc("n"), F.asc("o_custkey"))


@query("top1_busiest", f"""WITH {STAYS}
SELECT org_id, count(*) AS n FROM flagged WHERE class = {IP} GROUP BY 1 ORDER BY n DESC, org_id LIMIT 1""")
def q_top1_busiest(spark, sf):
    s = B.stays(spark, sf, [B.INPATIENT])
    return R.top1(s.groupBy("org_id").agg(F.count("*").alias("n")), "n", "org_id")


@query("hash_ordered_sample", f"""SELECT o_orderkey FROM orders WHERE o_orderpriority = {IP}
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|{SEED}'), o_orderkey LIMIT 220""")
def q_hash_ordered_sample(spark, sf):
    o = T(spark, sf, "orders", "o_orderkey", "o_orderpriority").where(F.col("o_orderpriority") == B.INPATIENT)
    return R.hash_ordered_sample(o, "o_orderkey", SEED, 220).select("o_orderkey")


@query("order_by_all", "SELECT * FROM nation ORDER BY n_nationkey, n_name, n_regionkey")
def q_order_by_all(spark, sf):
    n = T(spark, sf, "nation")
    return n.orderBy(*R.total_order(n))


@query("limit_clamp", f"""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate, l_extendedprice LIMIT {RESULT_ROW_CAP}""")
def q_limit_clamp(spark, sf):
    li = T(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice")
    o = li.orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice")
    return R.limit_clamp(o, 50_000).select("l_orderkey", "l_linenumber", "l_suppkey")


# --- 2.8 set operations --------------------------------------------------------------------

@query("union_all", """SELECT 'orders' AS table_name, count(*) AS row_count FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'customer', count(*) FROM customer""")
def q_union_all(spark, sf):
    return R.union_all([T(spark, sf, t).agg(F.count("*").alias("row_count")).select(
        F.lit(t).alias("table_name"), "row_count") for t in ("orders", "lineitem", "customer")])


@query("append_rows", f"""SELECT * FROM orders UNION ALL
(SELECT * FROM orders WHERE o_orderpriority = {IP}
 ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|{SEED}'), o_orderkey LIMIT 220)""")
def q_append_rows(spark, sf):
    o = T(spark, sf, "orders")
    dup = R.hash_ordered_sample(o.where(F.col("o_orderpriority") == B.INPATIENT), "o_orderkey", SEED, 220)
    return o.unionByName(dup)


PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _flag_name(p):
    return "p_" + p.split("-")[0]


@query("pairwise_overlap", "WITH f AS (SELECT o_custkey, " + ", ".join(
    f"bool_or(o_orderpriority = '{p}') AS {_flag_name(p)}" for p in PRIOS) + " FROM orders GROUP BY 1) " +
    " UNION ALL ".join(f"SELECT '{_flag_name(a)}' AS set_a, '{_flag_name(b)}' AS set_b, "
                       f"count(*) FILTER (WHERE {_flag_name(a)} AND {_flag_name(b)}) AS n_both FROM f"
                       for i, a in enumerate(PRIOS) for b in PRIOS[i + 1:]))
def q_pairwise_overlap(spark, sf):
    o = T(spark, sf, "orders", "o_custkey", "o_orderpriority")
    flags = o.groupBy("o_custkey").agg(*[F.bool_or(F.col("o_orderpriority") == p).alias(_flag_name(p))
                                         for p in PRIOS])
    return R.pairwise_overlap(flags, [_flag_name(p) for p in PRIOS])


@query("result_diff", """WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem),
b AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT *, 'left' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'right' AS only_in FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def q_result_diff(spark, sf):
    a = T(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    return R.result_diff(a, a.distinct())
