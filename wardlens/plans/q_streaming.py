"""Registered streaming re-aims (survey 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import hash_order_key
from ..sources.files import scratch_path
from ..sources.tables import DRIVER_TABLES, read_table
from ..streaming.feeds import stream_dedupe, stream_run_totals
from .bindings import SAMPLE_SEED
from .q_describe import write_span_logs
from .registry import query


def write_feed(spark, sf) -> str:
    """B-FEED delivered as two files: every event, then a re-delivery of the events
    whose md5(id | seed) starts with 0-2 (about 3 in 16)."""
    e = read_table(spark, sf, "events")
    path = scratch_path(spark, "feed")
    e.write.mode("overwrite").parquet(f"{path}/part=0")
    again = e.where(F.substring(hash_order_key("event_id", SAMPLE_SEED), 1, 1).isin("0", "1", "2"))
    again.write.mode("overwrite").parquet(f"{path}/part=1")
    return path


@query("stream_dedupe", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_stream_dedupe(spark, sf):
    feed = write_feed(spark, sf)
    return stream_dedupe(spark, feed, DRIVER_TABLES["events"], "event_id", "ts")


@query("stream_run_totals", """SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS n_spans,
  round(sum(round(value / 1000, 6)), 6) AS cost_usd FROM events GROUP BY 1""")
def q_stream_run_totals(spark, sf):
    return stream_run_totals(spark, write_span_logs(spark, sf))
