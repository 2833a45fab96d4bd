"""File sources and sinks: typed CSV ingest with header checks, whole-text corpus,
span logs, and the capped Parquet result sink."""

from __future__ import annotations

import os
import re
import urllib.parse
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import RESULT_ROW_CAP, SAMPLE_ROWS
from ..session import ensure_checkpoint_dir

CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
CSV_TIMESTAMP_NTZ_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and continue from
    the stored rows: cuts lineage, survives executor loss, and pins values that
    depend on physical layout (partition ids) so every later read sees the same."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def typed_csv_ingest(spark: SparkSession, path: str, schema: T.StructType,
                     timestamp_ntz_format: str = CSV_TIMESTAMP_NTZ_FORMAT) -> DataFrame:
    """Declared types, never inferred; empty string -> NULL; a bad value or a header
    that does not match the schema (names, order) fails the read instead of loading
    shifted or NULLed columns."""
    return (spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("mode", "FAILFAST")
            .option("nullValue", "")
            .option("timestampNTZFormat", timestamp_ntz_format)
            .csv(path))


# --- many files -------------------------------------------------------------------------

DIRECT_SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")     # stores that Arrow opens


def file_list(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of every file below ``path``, as Spark's readers list it: the
    driver holds every name, so this is for the files of a table that Spark reads.  No content is read.
    Files without a byte are not listed, as all of Spark's readers skip them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path) \
        .select("path", "length", F.col("modificationTime").alias("modified"))


FILE_ENTRY = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("folder", pa.bool_())])
LIST_FOLDERS, TASK_FILES, TASK_BYTES = 1_000, 1_000, 32 << 20     # of a task, at most; but for one longer file
BATCH_BYTES = 8 << 20


def _root(spark: SparkSession, path: str) -> str | None:
    """The full name of a folder that Arrow opens; None for anything else."""
    import pyarrow.fs as fs
    scheme = urllib.parse.urlsplit(path).scheme
    if scheme not in DIRECT_SCHEMES:
        return None
    if not scheme and not (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:"):
        return None
    root = "file:" + os.path.abspath(path.split(":", 1)[-1]).replace("//", "/", 1) if scheme in ("", "file") else path.rstrip("/")
    try:
        store, inside = _store_of(root)
        return root if store.get_file_info(inside).type == fs.FileType.Directory else None
    except (OSError, ValueError, ImportError, NotImplementedError):
        return None


def _seen(name: str) -> bool:
    """Whether Spark's readers list a name."""
    return not (name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_"))


def _entries(root: str):
    """Folders (path): what lies in them."""
    def run(batches):
        import pyarrow.fs as fs
        store, base = _store_of(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [i for i in store.get_file_info(fs.FileSelector(base + folder[len(root):])) if _seen(i.base_name)]
                for at in range(0, len(found), 10_000):
                    part = found[at:at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((
                        [f"{folder.rstrip('/')}/{i.base_name}" for i in part], [i.size or 0 for i in part],
                        [None if i.mtime_ns is None else i.mtime_ns // 1_000_000 * 1_000 for i in part],
                        [i.type == fs.FileType.Directory for i in part]), FILE_ENTRY.types)], schema=FILE_ENTRY)
    return run


def _name_pattern(pattern: str) -> str:
    """A glob of names (``*``, ``?``, ``{a,b}``) as a regular expression."""
    as_re = {"*": ".*", "?": ".", "{": "(?:", "}": ")", ",": "|"}
    return "(?s)^" + "".join(as_re.get(c) or re.escape(c) for c in pattern) + "$"


def listed_in_tasks(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``file_list`` of a folder that Arrow opens, without a name in the driver: tasks list
    the folders, one level after the other, and the list is written."""
    level, found = spark.createDataFrame([(root,)], "path string"), []
    while level is not None:
        got = materialise(level.mapInArrow(_entries(root), "path string, length long, modified timestamp, folder boolean"), "files")
        found.append(got.where("NOT folder AND length > 0").drop("folder"))
        below = got.where("folder").select("path")
        n = below.count()
        level = below.repartition(max(min(n, spark.sparkContext.defaultParallelism), -(-n // LIST_FOLDERS)), "path") if n else None
    return reduce(DataFrame.unionByName, found).where(F.regexp_extract("path", "[^/]*$", 0).rlike(_name_pattern(pattern)))


def dealt(files: DataFrame) -> DataFrame:
    """Listed files, a bounded share of them to a task."""
    size = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    few = min(size["n"], files.sparkSession.sparkContext.defaultParallelism)
    return files.repartition(max(1, few, -(-size["n"] // TASK_FILES), -(-size["bytes"] // TASK_BYTES)), "path")


def decoded_path(path) -> Column:
    """A path as files are named, from the encoded one of ``_metadata``."""
    c = F.col(path) if isinstance(path, str) else path
    return F.url_decode(F.regexp_replace(c, r"\+", "%2B"))


def _store_of(path: str):
    """The Arrow file system of a path, and the path inside it."""
    import pyarrow.fs as fs
    scheme = urllib.parse.urlsplit(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), path.split(":", 1)[1] if scheme else path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _first_line(path: str) -> str:
    store, inside = _store_of(path)
    line = b""
    with store.open_input_stream(inside) as f:
        while b"\n" not in line:
            more = f.read(1 << 16)
            if not more:
                break
            line += more
    return line.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig", "replace")


def first_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, line): the first line of every file below ``path``, without a byte-order mark.
    Only the head of a file is read, a bounded share of the list
    in each task.  In a store that Arrow does not open, Spark scans the files."""
    root = _root(spark, path)
    listed = file_list(spark, path, pattern) if root is None else dealt(listed_in_tasks(spark, root, pattern))
    if urllib.parse.urlsplit(path).scheme in DIRECT_SCHEMES:
        def heads(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"path": batch.column(0), "line": [_first_line(p) for p in batch.column(0).to_pylist()]})

        return listed.select("path").mapInArrow(heads, "path string, line string")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    first = lines.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("file"), at.alias("at"), "value") \
        .groupBy("name", "file").agg(F.regexp_replace(F.min_by("value", "at"), "^\ufeff|\r$", "").alias("line"))
    return listed.join(first, F.col("path") == decoded_path("file"), "left").select("path", F.coalesce("line", F.lit("")).alias("line"))


def header_conformity(spark: SparkSession, path: str, expected: list[str], table: str, pattern: str = "*.csv") -> DataFrame:
    """Exact header match ignoring case, BOM removed: one row for every file below ``path``."""
    want = ",".join(expected)
    return first_lines(spark, path, pattern).select(
        F.lit(table).alias("table_name"), F.col("path").alias("file"), F.lit(want).alias("expected_header"),
        F.col("line").alias("actual_header"), (F.lower("line") == F.lit(want.lower())).alias("header_ok"))


def write_csv(df: DataFrame, path: str) -> str:
    (df.write.mode("overwrite").option("header", True)
       .option("timestampNTZFormat", CSV_TIMESTAMP_NTZ_FORMAT).csv(path))
    return path


CORPUS_FOLDERS = 256             # at most, however many documents


JSON_BYTES = 32 << 20            # a longer file of rows goes to Spark's reader, which splits it
CORPUS_ROW = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())])


def _uri(path: str) -> str:
    """A path as ``_metadata.file_path`` has it."""
    scheme, at, rest = path.partition(":")
    return scheme + at + re.sub(r"[^\w\-!.~'()*,;:$&+=/@]", lambda m: m[0] if m[0] > "\x7f" and not m[0].isspace() else urllib.parse.quote(m[0]), rest)


def _contents(root: str, lines: bool):
    """Files (path): their bytes, or each of their lines that is text."""
    def run(batches):
        store, base = _store_of(root)
        kind = pa.string() if lines else pa.binary()
        for batch in batches:
            paths, values, held = [], [], 0
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(base + path[len(root):], compression=None) as f:
                    content = f.read()
                for value in content.splitlines() if lines else [content]:
                    if lines:
                        try:
                            value = value.decode().removeprefix("\ufeff")
                        except UnicodeDecodeError:        # no row of JSON
                            continue
                    paths.append(_uri(path))
                    values.append(value)
                    held += len(value)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, kind)], names=["path", "value"])
                        paths, values, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, kind)], names=["path", "value"])
    return run


def _corpus_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("doc_id").isNotNull())


def _corpus_by_reader(spark: SparkSession, corpus_dir: str) -> DataFrame:
    """For a store that only Spark opens: its readers hold the names of all files in the driver."""
    if file_list(spark, corpus_dir, "*.{md,txt,json,jsonl}").isEmpty():
        raise ValueError(f"no document in {corpus_dir}")
    below = spark.read.option("recursiveFileLookup", True)
    path = F.col("_metadata.file_path")
    whole = below.option("pathGlobFilter", "*.{md,txt}").text(corpus_dir, wholetext=True).select(
        decoded_path(F.regexp_extract(path, r"([^/]+)\.(md|txt)$", 1)).alias("doc_id"), path.alias("path"),
        F.col("value").alias("text"))
    rows = below.option("pathGlobFilter", "*.{json,jsonl}").schema(CORPUS_ROW).json(corpus_dir)
    return whole.unionByName(_corpus_rows(rows).select("doc_id", path.alias("path"), "text"))


def corpus_source(spark: SparkSession, corpus_dir: str) -> DataFrame:
    """(doc_id, path, text) of a corpus below ``corpus_dir``: every ``.md`` / ``.txt`` file
    as one document whose id is the file's stem, and every row (doc_id, text) with an id of its
    ``.json`` / ``.jsonl`` files.  A corpus that is absent or has no file is an error; an
    empty file is no document.  Files are listed and read in tasks, however many there are;
    names reach the driver only of files of rows beyond ``JSON_BYTES``."""
    root = _root(spark, corpus_dir)
    if root is None:
        return _corpus_by_reader(spark, corpus_dir)
    files = listed_in_tasks(spark, root, "*.{md,txt,json,jsonl}")
    if files.isEmpty():
        raise ValueError(f"no document in {corpus_dir}")
    is_text = F.col("path").rlike(r"\.(md|txt)$")
    texts = dealt(files.where(is_text)).select("path").mapInArrow(_contents(root, False), "path string, value binary")
    whole = texts.select(decoded_path(F.regexp_extract("path", r"([^/]+)\.(md|txt)$", 1)).alias("doc_id"), "path", F.col("value").cast("string").alias("text"))
    small = dealt(files.where(~is_text & (F.col("length") <= JSON_BYTES))).select("path").mapInArrow(_contents(root, True), "path string, value string")
    rows = small.select("path", F.inline(F.from_json("value", T.ArrayType(CORPUS_ROW))))
    out = whole.unionByName(_corpus_rows(rows).select("doc_id", "path", "text"))
    large = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in files.where(~is_text & (F.col("length") > JSON_BYTES)).select("path").collect()]
    if large:
        more = spark.read.schema(CORPUS_ROW).json(large).select("doc_id", F.col("_metadata.file_path").alias("path"), "text")
        out = out.unionByName(_corpus_rows(more))
    return out


def write_corpus(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """One text file per document, named by its id, in at most ``CORPUS_FOLDERS`` folders by
    a hash of the id.  A task that runs again writes the same files again.  Ids must be
    distinct and fit a file name."""
    folders = max(1, min(CORPUS_FOLDERS, docs.count() // 1_000))

    def write(batches):
        for batch in batches:
            for folder, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                store, inside = _store_of(f"{path}/{folder:03d}/{name}.txt")
                store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(inside) as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    named = docs.select(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(folders)).alias("folder"), F.col(id_col).cast("string"), text_col)
    named.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return path


def write_corpus_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """The corpus as rows of ``.json`` files, as many as ``docs`` has partitions."""
    docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).write.mode("overwrite").json(path + "/rows")
    return path


SPAN_ATTRS = T.StructType([
    T.StructField(n, t, True) for n, t in [
        ("subtask.id", T.StringType()), ("agent.role", T.StringType()), ("tool.name", T.StringType()),
        ("tool.args_hash", T.StringType()), ("context.bundle_tokens", T.LongType()),
        ("result_ref", T.StringType()), ("cost.usd", T.DoubleType()), ("model.id", T.StringType()),
        ("retry.count", T.LongType()), ("validation.passed", T.BooleanType()),
        ("cassette.mode", T.StringType()), ("gen_ai.usage.input_tokens", T.LongType()),
        ("gen_ai.usage.output_tokens", T.LongType())]])

SPAN_FIELDS = [
    T.StructField("name", T.StringType()), T.StructField("span_id", T.StringType()),
    T.StructField("trace_id", T.StringType()), T.StructField("parent_span_id", T.StringType()),
    T.StructField("start_time_ns", T.LongType()), T.StructField("end_time_ns", T.LongType()),
    T.StructField("duration_ms", T.DoubleType()), T.StructField("status", T.StringType())]
SPAN_SCHEMA = T.StructType([*SPAN_FIELDS, T.StructField("attributes", SPAN_ATTRS)])
# as logged: attributes of any name, values as text; the run may be named in the row
SPAN_LOG_SCHEMA = T.StructType([*SPAN_FIELDS, T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
                                T.StructField("run_id", T.StringType())])


def typed_attributes(attributes="attributes") -> Column:
    """The attributes that the operators use, typed, out of a map of all of them; a value
    that is not of its type is null."""
    m = F.col(attributes)
    return F.struct(*[m[f.name].try_cast(f.dataType).alias(f.name) for f in SPAN_ATTRS.fields])


def named_spans(logged: DataFrame) -> DataFrame:
    """Logged spans with typed ``attributes``, all of them by name in ``all_attributes``,
    and the run: the one that the row names, else the folder its file lies in."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    return logged.where(F.col("span_id").isNotNull()).select(
        *[f.name for f in SPAN_FIELDS], typed_attributes().alias("attributes"), F.col("attributes").alias("all_attributes"),
        F.coalesce("run_id", folder).alias("run_id"))


def span_source(spark: SparkSession, path: str) -> DataFrame:
    """Span JSON lines (blank lines skipped) below ``path``, many runs to a file or one."""
    return named_spans(spark.read.schema(SPAN_LOG_SCHEMA).option("mode", "PERMISSIVE")
                       .option("recursiveFileLookup", True).json(path))


def result_sink(df: DataFrame, path: str, asked_limit: int = RESULT_ROW_CAP) -> DataFrame:
    """Write a query's result to Parquet (limit clamped to the cap) and describe it: one row
    (ref, schema, row_count, head, n_bytes).  Rows are counted, and the first ones under a
    total order found, while they are written (a result is at most the cap, so the
    sort is bounded); bytes come from the files.  The result is computed once and not
    read again."""
    from pyspark.sql import Observation
    spark, n = df.sparkSession, max(1, min(int(asked_limit), RESULT_ROW_CAP))
    seen = Observation("result")
    fields = df.schema.fields
    # nulls last, in every column
    key = F.struct(*[x for i, f in enumerate(fields) for x in (F.col(f"`{f.name}`").isNull().alias(f"n{i}"), F.col(f"`{f.name}`").alias(f"v{i}"))])
    first = F.slice(F.array_sort(F.collect_list(key)), 1, SAMPLE_ROWS)
    df.limit(n).observe(seen, F.count("*").alias("row_count"), first.alias("head")).write.mode("overwrite").parquet(path)
    got = seen.get
    size = file_list(spark, path, "*.parquet").agg(F.sum("length")).first()[0]
    head = [tuple(r[f"v{i}"] for i in range(len(fields))) for r in got["head"]]
    told = T.StructType([T.StructField("ref", T.StringType()), T.StructField("schema", T.StringType()), T.StructField("row_count", T.LongType()),
                         T.StructField("head", T.ArrayType(df.schema)), T.StructField("n_bytes", T.LongType())])
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)
    return spark.createDataFrame([(path, schema, got["row_count"], head, size or 0)], told)
