"""Structured Streaming re-aims of two batch operators (same results as batch).

* ``stream_dedupe``: a feed that re-delivers events; each id is written once, however
  late its first delivery is.  The ids seen so far are state in RocksDB, of which a batch
  touches the ids that it delivers and checkpoints what it changed.
* ``stream_run_totals``: span logs appended as spans end; a run's totals are state until
  its root span closes it, and are then written once and forgotten.

Both run with ``availableNow`` triggers and keep their checkpoints in the shared
checkpoint folder, so a restarted query resumes from its last committed batch.
"""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import SPAN_LOG_SCHEMA, named_spans, scratch_path

# State lives on disk beside its task, and a commit uploads the changes alone.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
TOTALS = "run_id string, n_spans long, cost_usd double"


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's settings come back."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_dedupe(spark: SparkSession, feed_dir: str, schema: T.StructType, id_col: str, out_dir: str, ckpt: str):
    """The running query that appends the first delivery of every id to ``out_dir``."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed_dir)
    with state_store(spark):
        return src.dropDuplicates([id_col]).writeStream.format("parquet").option("path", out_dir) \
            .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()


def stream_dedupe(spark: SparkSession, feed_dir: str, schema: T.StructType, id_col: str, time_col: str | None = None,
                  out_dir: str | None = None) -> DataFrame:
    """The first delivery of every id, of deliveries in one batch any one.  No watermark, so
    no first delivery is too late; a batch that is run again adds nothing twice."""
    out = out_dir or scratch_path(spark, "dedupe-out")
    start_dedupe(spark, feed_dir, schema, id_col, out, scratch_path(spark, "dedupe-ckpt")).awaitTermination()
    return spark.read.schema(schema).parquet(out)


def _run_totals(key, frames, state: GroupState):
    """Add a batch's spans to a run; write and forget the run when its root has come.  The
    root repeats the total and is not counted.  A run whose root never comes stays open."""
    n, cost = state.get if state.exists else (0, 0.0)
    closed = False
    for f in frames:
        root = f["is_root"].to_numpy(bool)
        n, cost, closed = n + int((~root).sum()), cost + float(f["cost_usd"][~root].sum()), closed or bool(root.any())
    if closed:
        if state.exists:
            state.remove()
        yield pd.DataFrame({"run_id": [key[0]], "n_spans": [n], "cost_usd": [cost]})
    else:
        state.update((n, cost))


def start_run_totals(spark: SparkSession, spans_dir: str, out_dir: str, ckpt: str):
    """The running query that appends a row (run_id, n_spans, cost_usd) for each closed run."""
    logged = spark.readStream.schema(SPAN_LOG_SCHEMA).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", True).json(spans_dir)
    spans = named_spans(logged).select("run_id", F.coalesce(F.col("attributes")["cost.usd"], F.lit(0.0)).alias("cost_usd"),
                                       (F.col("name") == "run").alias("is_root"))
    totals = spans.groupBy("run_id").applyInPandasWithState(_run_totals, TOTALS, "n_spans long, cost_usd double", "append",
                                                            GroupStateTimeout.NoTimeout)
    with state_store(spark):
        return totals.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ckpt) \
            .outputMode("append").trigger(availableNow=True).start()


def stream_run_totals(spark: SparkSession, spans_dir: str, out_dir: str | None = None) -> DataFrame:
    """Totals of every closed run: spans and cost without the root.  Spans that come after
    their run was closed are rows of their own, so the rows of a run are added up."""
    out = out_dir or scratch_path(spark, "run-totals")
    start_run_totals(spark, spans_dir, out, scratch_path(spark, "run-totals-ckpt")).awaitTermination()
    return spark.read.schema(TOTALS).parquet(out).groupBy("run_id").agg(F.sum("n_spans").alias("n_spans"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
