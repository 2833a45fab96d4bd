"""Role bindings: map the roles the operators expect onto the driver tables.

Every operator takes role columns (``id``, ``start_ts``, ``stop_ts``, ``patient`` ...),
so the same operator runs on the nine-table warehouse schema (``from_encounters``)
and on the driver tables (``stays``).  The SQL oracles build the same bindings
(``plans/sqlparts.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

# Fixed role values of the driver binding.
INPATIENT = "1-URGENT"
EMERGENCY = "2-HIGH"
OBSERVATION = "3-MEDIUM"
PERIOD_START = "1998-01-01"
PERIOD_END = "1999-01-01"          # half-open: [start, end)
SPLIT_DATE = "1998-07-01"          # mid-period boundary used by the injections
OPEN_FROM = "1998-01-01"           # open-stay injection applies from here on
SAMPLE_SEED = 20260806

STAY_COLUMNS = ("id", "okey", "lnum", "start_ts", "stop_ts", "patient", "organization",
                "org_id", "class", "payer", "cost", "covered", "cause")


def supplier_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> organisation (region name).

    nation (25 rows) and region (5 rows) are fixed-size dimensions by the TPC-H
    definition, so broadcasting them is bounded; supplier itself is not
    broadcast here and is left to AQE's size check.
    """
    sup = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    reg = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return (sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey)
               .join(F.broadcast(reg), F.col("n_regionkey") == reg.r_regionkey)
               .select(F.col("s_suppkey"), F.col("r_name").alias("organization")))


def line_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem-level roles of B-STAY (everything that may differ between copies
    of an id): stop, organisation, supplier, cost, covered, cause."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey",
                    "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    lis = li.join(supplier_org(spark, sf_dir), li.l_suppkey == F.col("s_suppkey"))
    return lis.select(
        F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("lnum"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.lit(None))
         .otherwise(F.col("l_shipdate")).cast("timestamp_ntz").alias("stop_ts"),
        F.col("organization"), F.col("l_suppkey").alias("org_id"), F.col("l_extendedprice").alias("cost"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("covered"),
        F.col("l_returnflag").alias("cause"))


def order_roles(spark: SparkSession, sf_dir: str, classes=None, start_window=None) -> DataFrame:
    """The order-level roles (equal on every copy of an id): start, patient, class, payer.

    Class and start-window filters are applied here, before any join, so they reach
    the parquet scan as pushed filters."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                        "o_orderpriority")
    if classes is not None:
        orders = orders.where(F.col("o_orderpriority").isin(list(classes)))
    if start_window is not None:
        lo, hi = start_window
        orders = orders.where((F.col("o_orderdate") >= F.lit(lo).cast("timestamp_ntz"))
                              & (F.col("o_orderdate") < F.lit(hi).cast("timestamp_ntz")))
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    oc = orders.join(cust, orders.o_custkey == cust.c_custkey)
    return oc.select(F.col("o_orderkey").alias("okey"), F.col("o_orderdate").alias("start_ts"),
                     F.col("o_custkey").alias("patient"), F.col("o_orderpriority").alias("class"),
                     F.col("c_mktsegment").alias("payer"))


def _finish(j: DataFrame) -> DataFrame:
    return j.select(
        F.concat(F.col("okey").cast("string"), F.lit("-"), F.col("lnum").cast("string")).alias("id"),
        "okey", "lnum", "start_ts", "stop_ts", "patient", "organization", "org_id", "class", "payer",
        "cost", "covered", "cause")


# Total order that picks the surviving copy of a repeated id: stop (NULL last),
# then every other bound column, so the choice is deterministic in any engine.
DEDUP_ORDER = ("stop_ts", "organization", "cost", "org_id", "covered", "cause")


def dedupe_min(df: DataFrame, keys, order=DEDUP_ORDER) -> DataFrame:
    """One row per key: the row that is smallest under ``order`` (ascending, NULLs
    last), then under the remaining columns.

    Written as ``min(struct)`` per key, so the aggregation combines copies map-side
    before the shuffle: a group of copies holding a third of all rows is reduced in
    every input partition first and never lands whole in one task."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    fields = [e for c in order for e in (F.col(c).isNull().alias(f"_n_{c}"), F.col(c).alias(c))]
    fields += [F.col(c).alias(c) for c in rest]
    m = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_m"))
    return m.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in list(order) + rest]).select(*df.columns)


def dedupe_stays(df: DataFrame, keys=("okey", "lnum")) -> DataFrame:
    """One row per id where copies may differ (see ``dedupe_min``)."""
    return dedupe_min(df, keys)


def stays(spark: SparkSession, sf_dir: str, classes=None, start_window=None) -> DataFrame:
    """B-STAY, de-duplicated: one row per encounter id.

    Copies are collapsed at line level (where all differing columns live) with a
    map-side-combined aggregation, then joined to the order roles."""
    # all copies of a line have its order, so the orders' filter may go first
    roles = order_roles(spark, sf_dir, classes, start_window)
    lines = line_stays(spark, sf_dir)
    if classes or start_window:
        lines = lines.join(roles.select("okey"), "okey", "left_semi")
    return _finish(dedupe_min(lines, ["okey", "lnum"]).join(roles, "okey"))


def from_encounters(enc: DataFrame) -> DataFrame:
    """Bind the reference's ``encounters`` table (and nothing else) to the stay roles."""
    return enc.select(
        F.col("Id").alias("id"), F.col("Id").alias("okey"), F.lit(0).alias("lnum"),
        F.col("START").alias("start_ts"), F.col("STOP").alias("stop_ts"),
        F.col("PATIENT").alias("patient"), F.col("ORGANIZATION").alias("organization"),
        F.col("ORGANIZATION").alias("org_id"), F.col("ENCOUNTERCLASS").alias("class"),
        F.col("PAYER").alias("payer"), F.col("TOTAL_CLAIM_COST").alias("cost"),
        F.col("PAYER_COVERAGE").alias("covered"), F.col("REASONCODE").alias("cause"))


def coverage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-COV: patient, payer, from = order date, to = next order date of the customer."""
    from ..operators.relational import ranked_within
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    # next order of the customer: rank orders per customer (skew-safe), then an
    # equi-join on (customer, rank + 1) instead of a lead() window over the customer
    r = ranked_within(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], rank_col="_r")
    nxt = r.select(F.col("o_custkey").alias("_c"), (F.col("_r") - 1).alias("_r"), F.col("o_orderdate").alias("to_ts"))
    j = r.join(nxt, (r.o_custkey == nxt._c) & (r._r == nxt._r), "left")
    return j.select(F.col("o_custkey").alias("patient"), F.col("o_orderpriority").alias("payer"),
                    F.col("o_orderdate").alias("from_ts"), "to_ts")


def warehouse(spark: SparkSession, sf_dir: str):
    """The nine-table warehouse roles the injections work on, bound to the driver
    tables: encounters = every lineitem row (copies kept, stops always set),
    organizations = suppliers (name = region, city = nation), payers = segments."""
    from ..operators.quality import Warehouse
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    oc = orders.join(cust, orders.o_custkey == cust.c_custkey)
    enc = li.join(oc, li.l_orderkey == oc.o_orderkey).select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("Id"),
        F.col("o_orderdate").alias("START"), F.col("l_shipdate").alias("STOP"),
        F.col("o_custkey").cast("string").alias("PATIENT"),
        F.col("l_suppkey").cast("string").alias("ORGANIZATION"),
        F.col("c_mktsegment").alias("PAYER"), F.col("o_orderpriority").alias("ENCOUNTERCLASS"))
    sup = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    reg = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    org = (sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey)
              .join(F.broadcast(reg), F.col("n_regionkey") == reg.r_regionkey)
              .select(F.col("s_suppkey").cast("string").alias("Id"), F.col("r_name").alias("NAME"),
                      F.col("n_name").alias("CITY")))
    seg = read_table(spark, sf_dir, "customer", "c_mktsegment").distinct()
    pay = seg.select(F.col("c_mktsegment").alias("Id"),
                     F.concat(F.upper(F.substring("c_mktsegment", 1, 1)),
                              F.lower(F.expr("substring(c_mktsegment, 2)"))).alias("NAME"))
    return Warehouse(enc, org, pay)


def recipe():
    from ..operators.quality import Recipe
    return Recipe(inpatient=INPATIENT, open_from=OPEN_FROM, reversed_before=OPEN_FROM,
                  split_date=SPLIT_DATE, merger_date=SPLIT_DATE,
                  payer_year=(PERIOD_START, PERIOD_END), dup_year=(PERIOD_START, PERIOD_END))


def deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient, death_ts): a customer with a low balance dies at the end of the last inpatient
    stay that ends in the reporting period."""
    lost = read_table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").where("c_acctbal < 500")
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").where(F.col("o_orderpriority") == INPATIENT)
    ends = F.col("l_shipdate")
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate") \
        .where((ends >= F.lit(PERIOD_START).cast("timestamp_ntz")) & (ends < F.lit(PERIOD_END).cast("timestamp_ntz")))
    return li.join(o, li.l_orderkey == o.o_orderkey).join(lost, F.col("o_custkey") == F.col("c_custkey")) \
        .groupBy(F.col("o_custkey").alias("patient")).agg(F.max("l_shipdate").alias("death_ts"))


def _lines_as_ids(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", *cols)
    return li.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"), *cols)


def against_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): stays of which a copy has the highest tax."""
    return _lines_as_ids(spark, sf_dir, "l_tax").where("l_tax >= 0.08").select("id").distinct()


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): stays of which a copy has no discount."""
    return _lines_as_ids(spark, sf_dir, "l_discount").where("l_discount = 0").select("id").distinct()


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, code): the codes of a stay, from all of its copies: the part's group and the return flag
    where it tells something."""
    li = _lines_as_ids(spark, sf_dir, "l_partkey", "l_returnflag")
    part = F.concat(F.lit("P"), (F.col("l_partkey") % 12).cast("string"))
    flag = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("R"), F.col("l_returnflag")))
    return li.select("id", F.explode(F.array_compact(F.array(part, flag))).alias("code")).distinct()


RETRIEVAL_DOCS = 3               # documents that a bound lookup names


def spans_from_events(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """B-SPAN as span records (the span-log schema): one span per event, parented by
    one root span per run whose cost repeats the run total, as a real log does.  Views are
    lookups: they carry retrieval attributes, some of them not all.  With ``since`` or
    ``until`` only the events of that period."""
    from ..functions.exprs import args_hash
    from ..sources.files import SPAN_ATTRS
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    if since:
        e = e.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        e = e.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    view = F.col("event_type") == "view"
    k = F.get_json_object("props", "$.k").cast("int")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    attributes = {
        "tool.name": text("event_type"), "tool.args_hash": args_hash("props"),
        "cost.usd": text(F.round(F.col("value") / 1000, 6)), "context.bundle_tokens": text(F.floor(F.col("value") * 10)),
        "validation.passed": F.when(F.col("event_type") == "error", "false").when(F.col("event_type") == "purchase", "true"),
        "agent.role": F.when(view, "planner").otherwise("sql_analyst"),
        "result_ref": F.when(F.col("event_type") != "error", F.concat(F.lit("ref-"), text("event_id"))),
        "retrieval.strategy": F.when(view, "bm25"), "retrieval.k": F.when(view, F.lit(str(RETRIEVAL_DOCS))),
        "retrieval.latency_ms": F.when(view, text("value")), "retrieval.backend": F.when(view, "spark"),
        "retrieval.corpus_version": F.when(view & (k > 5), F.concat(F.lit("v"), (k % 7).cast("string"))),
        "retrieval.scores": F.when(view & (k % 10 != 0), text("value")),
        "retrieval.doc_ids": F.when(view & (k % 15 != 0), F.concat(F.lit("doc-"), text(k)))}
    # what the map says as text, typed: a struct of values, of which unused ones are never computed
    known = attributes | {"cost.usd": F.round(F.col("value") / 1000, 6), "context.bundle_tokens": F.floor(F.col("value") * 10)}
    typed = lambda given: F.struct(*[given.get(f.name, F.lit(None)).try_cast(f.dataType).alias(f.name) for f in SPAN_ATTRS.fields])
    ev = e.select(
        F.col("user_id").alias("run_id"), text("event_id").alias("span_id"),
        F.concat(F.lit("root-"), text("user_id")).alias("parent_span_id"),
        F.when(view, "node").otherwise("tool.call").alias("name"),
        start.alias("start_time_ns"), (start + F.floor(F.col("value") * 1e6)).alias("end_time_ns"),
        F.col("value").alias("duration_ms"),
        typed(known).alias("attributes"),
        F.create_map(*[x for n, v in attributes.items() for x in (F.lit(n), v)]).alias("all_attributes"))
    root = ev.groupBy("run_id").agg(F.min("start_time_ns").alias("start_time_ns"),
                                     F.max("end_time_ns").alias("end_time_ns"),
                                     F.round(F.sum(F.col("attributes")["cost.usd"]), 6).alias("cost")).select(
        "run_id", F.concat(F.lit("root-"), text("run_id")).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"), F.lit("run").alias("name"),
        "start_time_ns", "end_time_ns", F.lit(0.0).alias("duration_ms"), typed({"cost.usd": F.col("cost")}).alias("attributes"),
        F.create_map(F.lit("cost.usd"), text("cost")).alias("all_attributes"))
    spans = ev.unionByName(root)
    return spans.select("run_id", "span_id", text("run_id").alias("trace_id"),
                        "parent_span_id", "name", "start_time_ns", "end_time_ns", "duration_ms",
                        F.when(F.col("attributes")["validation.passed"] == F.lit(False), "ERROR").otherwise("OK").alias("status"),
                        "attributes", "all_attributes")
