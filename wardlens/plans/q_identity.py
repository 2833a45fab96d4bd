"""Registered identity and drift queries (survey 2.13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import recipe_of
from ..operators import identity as I
from ..sources.files import file_list, materialise, scratch_path
from ..sources.tables import DRIVER_TABLES, TABLE_NAMES, read_table
from . import bindings as B
from .q_quality import MESSY
from .registry import query

RECIPE = "driver-tables"


def exact_double_sql(x: str) -> str:
    """DuckDB twin of ``functions.exprs.exact_double``."""
    size = f"abs({x})"
    guess = f"CASE WHEN {x} = 0 OR isnan({x}) OR isinf({x}) THEN 0 ELSE floor(log2({size})) END"
    part = f"({size} / pow(2.0, {guess}))"
    exponent = f"({guess} + CASE WHEN {part} >= 2 THEN 1 WHEN {part} < 1 THEN -1 ELSE 0 END)"
    whole = f"({part} * CASE WHEN {part} >= 2 THEN 0.5 WHEN {part} < 1 THEN 2.0 ELSE 1.0 END * 4503599627370496.0)"
    return (f"CASE WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN CASE WHEN {x} < 0 THEN '-inf' ELSE 'inf' END WHEN {x} = 0 THEN '0' "
            f"WHEN {x} IS NOT NULL THEN CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(CAST({whole} AS BIGINT) AS VARCHAR) || 'p' "
            f"|| CAST(CAST({exponent} AS INTEGER) AS VARCHAR) END")


def canonical_field_sql(name: str, dtype: str) -> str:
    """DuckDB twin of ``functions.exprs.canonical_field``."""
    c = f'"{name}"'
    if dtype in ("double", "float"):
        s = exact_double_sql(f"CAST({c} AS DOUBLE)")
    elif dtype.startswith("timestamp"):
        s = f"CAST(epoch_us({c}) AS VARCHAR)"
    elif dtype.startswith("array"):
        s = f"array_to_string(list_transform({c}, lambda x: {exact_double_sql('CAST(x AS DOUBLE)')}), ',')"
    else:
        s = f"CAST({c} AS VARCHAR)"
    return f"coalesce(CAST(length({s}) AS VARCHAR) || ':' || {s}, '-')"


def digest_sql(table: str, columns: list[tuple[str, str]], label: str | None = None) -> str:
    row = "concat_ws('|', " + ", ".join(canonical_field_sql(n, t) for n, t in columns) + ")"
    return (f"SELECT '{label or table}' AS table_name, count(*) AS row_count, "
            f"CAST(coalesce(sum(CAST(md5_number({row}) % 1000000007 AS DECIMAL(38,0))), 0) AS DECIMAL(38,0)) AS digest "
            f"FROM {table}")


def _cols(t):
    return [(f.name, f.dataType.simpleString()) for f in DRIVER_TABLES[t].fields]


DIGESTS_SQL = " UNION ALL ".join(digest_sql(t, _cols(t)) for t in sorted(TABLE_NAMES))


@query("table_digest", DIGESTS_SQL)
def q_table_digest(spark, sf):
    return I.table_digests({t: read_table(spark, sf, t) for t in TABLE_NAMES})


@query("stored_digest", f"""SELECT 'first' AS state, d.*, true AS few_read FROM ({digest_sql("(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')", _cols("orders"), "orders")}) d
UNION ALL SELECT 'appended', d.*, true FROM ({digest_sql("orders", _cols("orders"))}) d
UNION ALL SELECT 'unchanged', d.*, true FROM ({digest_sql("orders", _cols("orders"))}) d""")
def q_stored_digest(spark, sf):
    """orders up to a date, then with the later ones appended, then once more: each run reads
    the files that the one before did not see."""
    o, path, state = read_table(spark, sf, "orders"), scratch_path(spark, "digest-table"), scratch_path(spark, "digest-state")
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    runs, seen = [], 0
    for name, part in (("first", ~late), ("appended", late), ("unchanged", None)):
        if part is not None:
            o.where(part).write.mode("append").parquet(path)
        n = file_list(spark, path, "*.parquet").count()
        d = materialise(I.stored_digest(spark, path, "orders", state), "digest-run")
        runs.append(d.select(F.lit(name).alias("state"), "table_name", "row_count", "digest", (F.col("files_read") == n - seen).alias("few_read")))
        seen = n
    return reduce(DataFrame.unionByName, runs)


@query("warehouse_fingerprint", f"""WITH d AS ({DIGESTS_SQL})
SELECT left(sha256(string_agg(table_name || ':' || CAST(row_count AS VARCHAR) || ':' || CAST(digest AS VARCHAR) || chr(10), ''
  ORDER BY table_name)), 12) AS fingerprint, count(*) AS n_tables,
  '{RECIPE}+content.' || left(sha256(string_agg(table_name || ':' || CAST(row_count AS VARCHAR) || ':' || CAST(digest AS VARCHAR) || chr(10), ''
  ORDER BY table_name)), 12) AS version, '{RECIPE}' AS recipe FROM d""")
def q_warehouse_fingerprint(spark, sf):
    d = I.table_digests({t: read_table(spark, sf, t) for t in TABLE_NAMES})
    return I.warehouse_fingerprint(d, RECIPE).withColumn("recipe", recipe_of("version"))


def corpus_sql(table: str, key: str, p: str = "") -> str:
    """Two levels of the tree: enough for CORPUS_FAN squared documents."""
    return f"""{p}entry AS (SELECT coalesce(CAST({key} AS VARCHAR), '-') AS id, coalesce(sha256(text), '-') AS h FROM {table}),
{p}leaves AS (SELECT CAST(ceil(count(*) / {I.CORPUS_FAN}.0) AS BIGINT) AS n FROM {table}),
{p}leaf AS (SELECT CAST(md5_number(id) % (SELECT n FROM {p}leaves) AS BIGINT) AS bucket,
  sha256(string_agg(id || ':' || h, chr(10) ORDER BY id, h)) AS leaf_hash, count(*) AS n FROM {p}entry GROUP BY 1),
{p}cv AS (SELECT left(sha256(string_agg(CAST(bucket AS VARCHAR) || ':' || leaf_hash, chr(10) ORDER BY bucket)), 16) AS corpus_version,
  CAST(sum(n) AS BIGINT) AS n_documents FROM {p}leaf)"""


CORPUS_SQL = corpus_sql("documents", "doc_id")


@query("corpus_version", f"WITH {CORPUS_SQL} SELECT * FROM cv")
def q_corpus_version(spark, sf):
    return I.corpus_version(read_table(spark, sf, "documents", "doc_id", "text"))


@query("content_hash_drift", """SELECT item_id AS key, sha256(text) AS recorded_sha,
  sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS current_sha,
  CASE WHEN sha256(text) = sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) THEN 'match' ELSE 'drift' END AS status
FROM benchmark""")
def q_content_hash_drift(spark, sf):
    """Frozen benchmark texts (recorded hashes) against the same texts after the
    whitespace normalisation a loader applies: which items would drift."""
    b = read_table(spark, sf, "benchmark", "item_id", "text")
    rec = b.select(F.col("item_id").alias("key"), F.sha2("text", 256).alias("recorded_sha"))
    cur = b.select(F.col("item_id").alias("key"),
                   F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return I.content_hash_drift(rec, cur)


_WH_COLS = {"encounters": [("Id", "string"), ("START", "timestamp_ntz"), ("STOP", "timestamp_ntz"),
                           ("PATIENT", "string"), ("ORGANIZATION", "string"), ("PAYER", "string"),
                           ("ENCOUNTERCLASS", "string")],
            "organizations": [("Id", "string"), ("NAME", "string"), ("CITY", "string")],
            "payers": [("Id", "string"), ("NAME", "string")]}
_BEFORE = {"encounters": "enc0", "organizations": "org0", "payers": "pay0"}
_AFTER = {"encounters": "enc5", "organizations": "org1", "payers": "pay2"}


def fingerprint_sql(digests: str) -> str:
    """The stamped version of a digest table, as a scalar subquery."""
    return (f"(SELECT '{RECIPE}+content.' || left(sha256(string_agg(table_name || ':' || CAST(row_count AS VARCHAR) || ':' || "
            f"CAST(digest AS VARCHAR) || chr(10), '' ORDER BY table_name)), 12) FROM {digests})")


def _snapshot_digests(spark, sf):
    """Digests of the warehouse tables before and after the injections."""
    from .q_quality import injected
    base, after = B.warehouse(spark, sf), injected(spark, sf)[0]
    return [I.table_digests({n: getattr(w, n) for n in _WH_COLS}) for w in (base, after)]


_DIGESTS = ", bef AS (" + " UNION ALL ".join(digest_sql(_BEFORE[t], c, t) for t, c in _WH_COLS.items()) + "), aft AS (" + \
    " UNION ALL ".join(digest_sql(_AFTER[t], c, t) for t, c in _WH_COLS.items()) + ")"

# Fixed times at which the bound versions came into force; each axis has an earlier and a
# later version.
SINCE = {"warehouse": ("2024-01-01 01:30:00", "2024-01-01 04:00:00"), "prompts": ("2024-01-01 02:00:00", "2024-01-01 07:00:00"),
         "corpus": ("2024-01-01 02:00:00", "2024-01-01 11:00:00"), "sandbox": ("2024-01-01 02:00:00", "2024-01-01 18:00:00")}

HISTORY_SQL = f"""{MESSY}{_DIGESTS}, {corpus_sql("benchmark", "item_id", "b_")}, {corpus_sql("documents", "doc_id", "d_")},
opening AS (SELECT conv_id, sha256(text) AS h FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
  WHERE rn = 1),
sandbox_old AS ({digest_sql("region", _cols("region"))}), sandbox_new AS ({digest_sql("nation", _cols("nation"))}),
history AS (
  SELECT 'warehouse' AS axis, TIMESTAMP '{SINCE["warehouse"][0]}' AS since, {fingerprint_sql("bef")} AS version
  UNION ALL SELECT 'warehouse', TIMESTAMP '{SINCE["warehouse"][1]}', {fingerprint_sql("aft")}
  UNION ALL SELECT 'prompts', TIMESTAMP '{SINCE["prompts"][0]}', (SELECT h FROM opening ORDER BY conv_id LIMIT 1)
  UNION ALL SELECT 'prompts', TIMESTAMP '{SINCE["prompts"][1]}', (SELECT h FROM opening ORDER BY conv_id DESC LIMIT 1)
  UNION ALL SELECT 'corpus', TIMESTAMP '{SINCE["corpus"][0]}', (SELECT corpus_version FROM b_cv)
  UNION ALL SELECT 'corpus', TIMESTAMP '{SINCE["corpus"][1]}', (SELECT corpus_version FROM d_cv)
  UNION ALL SELECT 'sandbox', TIMESTAMP '{SINCE["sandbox"][0]}', (SELECT CAST(digest AS VARCHAR) FROM sandbox_old)
  UNION ALL SELECT 'sandbox', TIMESTAMP '{SINCE["sandbox"][1]}', (SELECT CAST(digest AS VARCHAR) FROM sandbox_new)),
run_start AS (SELECT user_id AS run_id, min(ts) AS start_ts FROM events GROUP BY 1),
recorded AS (SELECT r.run_id, r.start_ts, w.version AS warehouse, p.version AS prompts, c.version AS corpus, s.version AS sandbox FROM run_start r
  ASOF LEFT JOIN (SELECT * FROM history WHERE axis = 'warehouse') w ON r.start_ts >= w.since
  ASOF LEFT JOIN (SELECT * FROM history WHERE axis = 'prompts') p ON r.start_ts >= p.since
  ASOF LEFT JOIN (SELECT * FROM history WHERE axis = 'corpus') c ON r.start_ts >= c.since
  ASOF LEFT JOIN (SELECT * FROM history WHERE axis = 'sandbox') s ON r.start_ts >= s.since),
newest AS (SELECT axis, max_by(version, since) AS version FROM history GROUP BY axis),
drift AS (SELECT run_id, CASE WHEN warehouse IS NULL AND prompts IS NULL AND corpus IS NULL AND sandbox IS NULL THEN 'none_recorded'
  WHEN warehouse IS DISTINCT FROM (SELECT version FROM newest WHERE axis = 'warehouse') THEN 'warehouse'
  WHEN prompts IS DISTINCT FROM (SELECT version FROM newest WHERE axis = 'prompts') THEN 'prompts'
  WHEN corpus IS DISTINCT FROM (SELECT version FROM newest WHERE axis = 'corpus') THEN 'corpus'
  WHEN sandbox IS DISTINCT FROM (SELECT version FROM newest WHERE axis = 'sandbox') THEN 'sandbox' ELSE 'current' END AS stale_axis FROM recorded),
stale AS (SELECT run_id, CASE WHEN stale_axis = 'none_recorded' THEN 'no version was recorded'
  WHEN stale_axis <> 'current' THEN 'recorded against another ' || stale_axis END AS stale_reason FROM drift)"""


def version_history(spark, sf):
    """(axis, since, version).  Warehouse: its fingerprint before and after the injections.
    Prompts: the opening turn of the first, later of the last dialogue.  Corpus: the
    benchmark texts, later the documents.  Sandbox: a small table that stands for the
    recipe, later another."""
    before, after = (I.warehouse_fingerprint(d, RECIPE).select("version") for d in _snapshot_digests(spark, sf))
    opening = I.window_first(read_table(spark, sf, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text", "t")
    prompt = lambda f: opening.agg(f("t", "conv_id").alias("t")).select(F.sha2("t", 256).alias("version"))
    corpus = lambda t, k: I.corpus_version(read_table(spark, sf, t, k, "text"), k).select(F.col("corpus_version").alias("version"))
    recipe = lambda t: I.table_digest(read_table(spark, sf, t), t).select(F.col("digest").cast("string").alias("version"))
    found = {"warehouse": (before, after), "prompts": (prompt(F.min_by), prompt(F.max_by)),
             "corpus": (corpus("benchmark", "item_id"), corpus("documents", "doc_id")), "sandbox": (recipe("region"), recipe("nation"))}
    return reduce(DataFrame.unionByName, [df.select(F.lit(a).alias("axis"), F.lit(t).cast("timestamp_ntz").alias("since"), "version")
                                          for a, pair in found.items() for t, df in zip(SINCE[a], pair)])


def run_verdicts(spark, sf):
    """Every run (user) by the versions in force at its first event."""
    history = materialise(version_history(spark, sf), "version-history")
    starts = read_table(spark, sf, "events", "user_id", "ts").groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("start_ts"))
    return I.drift_verdict(I.recorded_versions(starts, "start_ts", history), I.current_versions(history))


@query("drift_verdict", f"{HISTORY_SQL} SELECT * FROM drift")
def q_drift_verdict(spark, sf):
    return run_verdicts(spark, sf)


@query("snapshot_diff", MESSY + _DIGESTS + """
SELECT coalesce(b.table_name, a.table_name) AS table_name, b.row_count AS rows_before, b.digest AS digest_before,
  a.row_count AS rows_after, a.digest AS digest_after,
  NOT (b.digest IS NOT DISTINCT FROM a.digest AND b.row_count IS NOT DISTINCT FROM a.row_count) AS changed
FROM bef b FULL JOIN aft a ON b.table_name = a.table_name""")
def q_snapshot_diff(spark, sf):
    """Digests of the warehouse snapshot before and after the injections."""
    return I.snapshot_diff(*_snapshot_digests(spark, sf))
