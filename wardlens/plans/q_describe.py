"""Registered load / describe / source queries (survey 2.1-2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe as Dsc
from ..sources import files as Fs
from ..sources.tables import DRIVER_TABLES, TABLE_NAMES, read_table
from . import bindings as B
from .q_runs import SPANS_SQL
from .registry import query
from .sqlparts import STAYS

T = read_table
HORIZON_END = "2002-01-01"

_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
                                 for t in sorted(TABLE_NAMES))


@query("table_row_counts", _COUNTS_SQL)
def q_table_row_counts(spark, sf):
    return Dsc.table_row_counts({t: T(spark, sf, t) for t in TABLE_NAMES})


@query("schema_summary", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, "
    f"'{','.join(f.name for f in DRIVER_TABLES[t].fields)}' AS columns, 'present' AS status FROM {t}"
    for t in sorted(TABLE_NAMES)) +
    " UNION ALL SELECT 'payer_transitions', NULL::BIGINT, NULL::VARCHAR, 'absent'")
def q_schema_summary(spark, sf):
    return Dsc.schema_summary({t: T(spark, sf, t) for t in TABLE_NAMES},
                              expected=list(TABLE_NAMES) + ["payer_transitions"])


_TYPE_MAP = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' "
             "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END")


@query("table_profile", f"""SELECT 'orders' AS table_name, CAST(ordinal_position AS INTEGER) AS position,
  column_name, {_TYPE_MAP} AS data_type, is_nullable = 'YES' AS nullable,
  (SELECT count(*) FROM orders) AS row_count
FROM information_schema.columns WHERE table_name = 'orders'""")
def q_table_profile(spark, sf):
    return Dsc.table_profile(T(spark, sf, "orders"), "orders")


@query("ordered_sample", """SELECT * FROM orders ORDER BY o_orderkey ASC NULLS LAST, o_custkey ASC NULLS LAST,
  o_orderstatus ASC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderdate ASC NULLS LAST,
  o_orderpriority ASC NULLS LAST LIMIT 5""")
def q_ordered_sample(spark, sf):
    return Dsc.sample_rows(T(spark, sf, "orders"))


@query("load_shape_report", f"""WITH {STAYS},
g AS (SELECT class, count(*) AS n, count(*) FILTER (WHERE stop_ts IS NULL) AS n_open, min(start_ts) AS min_start,
  max(start_ts) AS max_start, count(*) FILTER (WHERE class = '{B.INPATIENT}' AND start_ts >= TIMESTAMP '{B.PERIOD_START}'
  AND start_ts < TIMESTAMP '{B.PERIOD_END}') AS n_iy FROM stays GROUP BY class)
SELECT 'class_count' AS metric, class AS key, CAST(n AS VARCHAR) AS value FROM g
UNION ALL SELECT 'open_stays', '', CAST(sum(n_open) AS VARCHAR) FROM g
UNION ALL SELECT 'min_start', '', strftime(min(min_start), '%Y-%m-%d %H:%M:%S') FROM g
UNION ALL SELECT 'max_start', '', strftime(max(max_start), '%Y-%m-%d %H:%M:%S') FROM g
UNION ALL SELECT 'inpatient_in_year', '', CAST(sum(n_iy) AS VARCHAR) FROM g""")
def q_load_shape_report(spark, sf):
    return Dsc.load_shape_report(B.stays(spark, sf), B.PERIOD_START, B.PERIOD_END, B.INPATIENT)


@query("horizon_check", f"""WITH {STAYS}
SELECT max(start_ts) AS max_start, count(start_ts) AS n_starts, TIMESTAMP '{HORIZON_END}' AS horizon_end,
  true AS horizon_ok FROM stays""")
def q_horizon_check(spark, sf):
    return Dsc.horizon_check(B.stays(spark, sf), HORIZON_END)


# --- sources and sinks ---------------------------------------------------------------------

@query("typed_csv_ingest", "SELECT * FROM orders")
def q_typed_csv_ingest(spark, sf):
    """orders written to CSV by Spark, loaded back with declared types and checks."""
    path = Fs.write_csv(T(spark, sf, "orders"), Fs.scratch_path(spark, "orders-csv"))
    return Fs.typed_csv_ingest(spark, path, DRIVER_TABLES["orders"],
                               timestamp_ntz_format="yyyy-MM-dd HH:mm:ss.SSSSSS")


_ORDER_COLUMNS = [f.name for f in DRIVER_TABLES["orders"].fields]
FILE_KEYS = 10_000               # order keys to a file


@query("header_conformity", f"""WITH files AS (SELECT DISTINCT CAST(o_orderkey // {FILE_KEYS} AS INTEGER) AS part FROM orders)
SELECT part, 'orders' AS table_name, '{",".join(_ORDER_COLUMNS)}' AS expected_header,
  '{",".join(_ORDER_COLUMNS)}' AS actual_header, true AS header_ok FROM files
UNION ALL SELECT -1, 'orders', '{",".join(_ORDER_COLUMNS)}', '{",".join(_ORDER_COLUMNS[::-1])}', false""")
def q_header_conformity(spark, sf):
    """orders as a file for every range of keys, and one more whose columns stand in
    another order."""
    o, path = T(spark, sf, "orders"), Fs.scratch_path(spark, "orders-hdr")
    part = F.floor(F.col("o_orderkey") / FILE_KEYS).cast("int")
    o.withColumn("part", part).repartition("part").write.option("header", True).partitionBy("part").csv(path)
    o.limit(1).select(*_ORDER_COLUMNS[::-1]).write.option("header", True).csv(f"{path}/part=-1")
    return Fs.header_conformity(spark, path, _ORDER_COLUMNS, "orders").select(
        F.regexp_extract("file", r"/part=(-?[0-9]+)/", 1).cast("int").alias("part"), "table_name", "expected_header", "actual_header", "header_ok")


@query("parquet_source", f"""SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{B.PERIOD_START}'
  AND o_orderdate < TIMESTAMP '{B.PERIOD_END}'""")
def q_parquet_source(spark, sf):
    from ..operators.metrics import in_window
    o = T(spark, sf, "orders").where(in_window("o_orderdate", B.PERIOD_START, B.PERIOD_END))
    path = Fs.scratch_path(spark, "result")
    o.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_ROW_TEXT = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("result_sink", f"""WITH r AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{B.PERIOD_START}'
  AND o_orderdate < TIMESTAMP '{B.PERIOD_END}' ORDER BY ALL LIMIT 10000)
SELECT '{",".join(f"{f.name}:{f.dataType.simpleString()}" for f in DRIVER_TABLES["orders"].fields)}' AS schema, count(*) AS row_count,
  (SELECT string_agg({" || '|' || ".join(_ROW_TEXT)}, ';' ORDER BY {", ".join(_ROW_TEXT)}) FROM (SELECT * FROM r ORDER BY ALL LIMIT 5)) AS head,
  true AS has_bytes FROM r""")
def q_result_sink(spark, sf):
    from ..operators.metrics import in_window
    from ..operators.relational import total_order
    o = T(spark, sf, "orders").where(in_window("o_orderdate", B.PERIOD_START, B.PERIOD_END))
    told = Fs.result_sink(o.orderBy(*total_order(o)), Fs.scratch_path(spark, "result"), 50_000)
    line = F.transform("head", lambda r: F.concat_ws("|", *[r[c].cast("string") for c in _ROW_TEXT]))
    return told.select("schema", "row_count", F.array_join(line, ";").alias("head"), (F.col("n_bytes") > 0).alias("has_bytes"))


RUN_FOLDERS, FOLDER_SPANS = 64, 50_000       # folders at most, however many runs; spans to one


def write_span_logs(spark, sf) -> str:
    """The bound spans (B-SPAN) as JSON lines, many runs to a file, by a hash of the run;
    root spans last, as a root ends after all others."""
    spans = B.spans_from_events(spark, sf)
    path = Fs.scratch_path(spark, "runs")
    folders = max(1, min(RUN_FOLDERS, T(spark, sf, "events", "event_id").count() // FOLDER_SPANS))
    out = spans.select(*[f.name for f in Fs.SPAN_FIELDS], F.col("all_attributes").alias("attributes"), F.col("run_id").cast("string").alias("run_id"),
                       F.pmod(F.xxhash64("run_id"), F.lit(folders)).alias("folder"))
    for part in (F.col("name") != "run", F.col("name") == "run"):
        out.where(part).repartition("folder").write.mode("append").partitionBy("folder").json(path)
    return path


@query("span_source", f"""WITH {SPANS_SQL} SELECT CAST(run_id AS VARCHAR) AS run_id, span_id, name, tool AS tool_name,
  cost_usd, passed AS validation_passed FROM steps""")
def q_span_source(spark, sf):
    spans = Fs.span_source(spark, write_span_logs(spark, sf))
    return spans.select("run_id", "span_id", "name", F.col("attributes.`tool.name`").alias("tool_name"),
                        F.col("attributes.`cost.usd`").alias("cost_usd"),
                        F.col("attributes.`validation.passed`").alias("validation_passed"))


@query("corpus_source", """SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS text_sha FROM documents
UNION ALL SELECT -1 - item_id, CAST(length(text) AS INTEGER), sha256(text) FROM benchmark""")
def q_corpus_source(spark, sf):
    """documents as a file each, the benchmark items as rows of a few files, read together."""
    path = Fs.write_corpus(T(spark, sf, "documents", "doc_id", "text"), Fs.scratch_path(spark, "corpus"))
    items = T(spark, sf, "benchmark", "item_id", "text").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    Fs.write_corpus_rows(items, path)
    c = Fs.corpus_source(spark, path)
    return c.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha"))
