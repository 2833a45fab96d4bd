"""Helpers shared by the operators of this package.

Conventions: an operator reads only the columns it names, so further columns of any
name do no harm.  A null text counts as empty.  A null doc_id sorts after every other
id (``NO_ID`` inside, null again in the result).  Rows may repeat; a row is identified
by (id, text_key), and rows equal in both get equal answers.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import make_importable
from ..sources.files import scratch_path

NO_ID = (1 << 63) - 1
SLICE_BYTES = 1 << 20          # text handled at a time by the vectorised scans
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def doc_rows(docs: DataFrame, *more: str) -> DataFrame:
    """(id, text) and the columns ``more``: ids and texts without nulls."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_key(text: str = "text") -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(text)


def with_key(docs: DataFrame) -> DataFrame:
    """(doc, _id, _tkey): the whole row, so that no column of ``docs`` can clash, and its
    ``doc_rows`` id and ``text_key``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tkey"))


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, out of ``doc``."""
    return [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]


def as_doc_id(col: str = "id") -> Column:
    return F.when(F.col(col) != NO_ID, F.col(col))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def settings(spark: SparkSession, **values):
    """Session settings for the time of one job; the caller's are put back."""
    names = {"cleanup": CLEANUP, "batch_rows": BATCH_ROWS, "batch_bytes": BATCH_BYTES}
    before = {names[k]: spark.conf.get(names[k], None) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], str(v).lower())
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size: texts can be long, and a worker holds a batch."""
    make_importable(spark)
    spark.conf.set(BATCH_ROWS, "2000")
    spark.conf.set(BATCH_BYTES, str(8 << 20))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and continue from
    there: cuts lineage, survives lost executors, and lets the shuffle files that
    made it go as soon as it is written."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with settings(spark, cleanup=True):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges [a, b) of consecutive rows of at most ``limit`` bytes (one row at least)."""
    ends, a, n = np.cumsum(sizes), 0, len(sizes)
    while a < n:
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield a, b
        a = b


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and its n + 1 offsets; no copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def strings_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t)
                                       for c, t in zip(columns, schema.types)], schema=schema)
