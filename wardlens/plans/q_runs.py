"""Registered run-analytics queries (survey 2.17) on the B-SPAN / B-DIALOG / B-LABEL
bindings.  The task rules (required tools, order pairs, minimum steps, cited
documents) are a small parameter record, like one task file of the reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import args_hash, token_estimate
from ..operators import runs as R
from ..operators.identity import staleness
from ..sources.tables import read_table
from . import bindings as B
from .q_identity import HISTORY_SQL, run_verdicts
from .registry import query

TASK = {"task_id": "purchase_path", "required_tools": ["view", "click", "purchase"],
        "forbidden_tools": ["error"], "required_order": [("view", "purchase"), ("click", "purchase")],
        "must_cite": ["doc-purchase", "doc-signup"], "min_steps": 3}

# Fixed prices per million tokens by model role (input, output).
PRICES = [("planner", 5.00, 25.00), ("sql_analyst", 2.00, 10.00), ("synthesizer", 5.00, 25.00)]


def _steps(spark, sf):
    return R.span_steps(B.spans_from_events(spark, sf))


def _ordered(spark, sf):
    return R.trajectory_order(_steps(spark, sf))


LOOP_COLUMNS = ("run_id", "span_id", "start_ns", "name", "tool", "args_hash")       # what the order and the loops need


def spans_sql(events: str = "events", p: str = "") -> str:
    """DuckDB twin of ``bindings.spans_from_events`` and of the run summary, as CTEs whose
    names begin with ``p``."""
    return f"""{p}ev AS (SELECT user_id AS run_id, CAST(event_id AS VARCHAR) AS span_id, 'root-' || CAST(user_id AS VARCHAR) AS parent_span_id,
  CASE WHEN event_type = 'view' THEN 'node' ELSE 'tool.call' END AS name, epoch_us(ts) * 1000 AS start_ns,
  epoch_us(ts) * 1000 + CAST(floor(value * 1e6) AS BIGINT) AS end_ns, value AS duration_ms, event_type AS tool, left(sha256(replace(props, ' ', '')), 16) AS args_hash,
  round(value / 1000, 6) AS cost_usd, CAST(floor(value * 10) AS BIGINT) AS bundle_tokens,
  CASE WHEN event_type = 'error' THEN false WHEN event_type = 'purchase' THEN true END AS passed,
  CASE WHEN event_type = 'view' THEN 'planner' ELSE 'sql_analyst' END AS role,
  CASE WHEN event_type <> 'error' THEN 'ref-' || CAST(event_id AS VARCHAR) END AS result_ref FROM {events}),
{p}root AS (SELECT run_id, 'root-' || CAST(run_id AS VARCHAR) AS span_id, NULL::VARCHAR AS parent_span_id, 'run' AS name,
  min(start_ns) AS start_ns, max(end_ns) AS end_ns, 0.0 AS duration_ms, NULL::VARCHAR AS tool, NULL::VARCHAR AS args_hash,
  round(sum(cost_usd), 6) AS cost_usd, NULL::BIGINT AS bundle_tokens, NULL::BOOLEAN AS passed, NULL::VARCHAR AS role,
  NULL::VARCHAR AS result_ref FROM {p}ev GROUP BY run_id),
{p}steps AS (SELECT * FROM {p}ev UNION ALL SELECT * FROM {p}root),
{p}ordered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY start_ns, span_id) AS step_no FROM {p}steps),
{p}flagged AS (SELECT *, coalesce(tool <> '', false) AND coalesce(args_hash <> '', false)
  AND row_number() OVER (PARTITION BY run_id, tool, args_hash ORDER BY step_no) > 1 AS is_repeat FROM {p}ordered),
{p}summary AS (SELECT run_id, count(*) FILTER (WHERE name IN ('node', 'tool.call')) AS steps,
  count(*) FILTER (WHERE tool <> '') AS tool_calls, count(*) FILTER (WHERE passed = false) AS validation_failures,
  count(*) FILTER (WHERE is_repeat) AS repeated_calls, max(CASE WHEN bundle_tokens <> 0 THEN bundle_tokens END) AS max_bundle,
  round(sum(CASE WHEN name <> 'run' THEN cost_usd ELSE 0.0 END), 6) AS cost_usd FROM {p}flagged GROUP BY run_id)"""


SPANS_SQL = spans_sql()
W = f"WITH {SPANS_SQL}"


@query("span_steps", f"{W} SELECT run_id, span_id, name, start_ns, tool, cost_usd, passed FROM steps")
def q_span_steps(spark, sf):
    return _steps(spark, sf).select("run_id", "span_id", "name", "start_ns", "tool", "cost_usd", "passed")


@query("trajectory_order", f"{W} SELECT run_id, span_id, CAST(step_no AS INTEGER) AS step_no FROM ordered")
def q_trajectory_order(spark, sf):
    return _ordered(spark, sf).select("run_id", "span_id", "step_no")


@query("span_tree", f"{W} SELECT run_id, span_id, CASE WHEN parent_span_id IS NULL THEN 0 ELSE 1 END AS depth FROM steps")
def q_span_tree(spark, sf):
    return R.span_tree(_steps(spark, sf))


@query("tool_calls", f"""{W} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY step_no) AS INTEGER) AS call_no, tool
FROM ordered WHERE tool <> ''""")
def q_tool_calls(spark, sf):
    return R.tool_calls(_steps(spark, sf))


@query("run_cost", f"{W} SELECT run_id, cost_usd FROM summary")
def q_run_cost(spark, sf):
    return R.run_totals(_steps(spark, sf)).select("run_id", "cost_usd")


@query("step_count", f"{W} SELECT run_id, steps FROM summary")
def q_step_count(spark, sf):
    return R.run_totals(_steps(spark, sf)).select("run_id", "steps")


@query("validation_failures", f"{W} SELECT run_id, validation_failures FROM summary")
def q_validation_failures(spark, sf):
    return R.run_totals(_steps(spark, sf)).select("run_id", "validation_failures")


@query("repeated_calls", f"{W} SELECT run_id, span_id FROM flagged WHERE is_repeat")
def q_repeated_calls(spark, sf):
    return R.repeated_calls(_steps(spark, sf))


@query("max_bundle", f"{W} SELECT run_id, max_bundle FROM summary")
def q_max_bundle(spark, sf):
    return R.run_totals(_steps(spark, sf)).select("run_id", "max_bundle")


@query("run_summary", f"{W} SELECT * FROM summary")
def q_run_summary(spark, sf):
    return R.run_summary(_steps(spark, sf))


DIALOG_SQL = """d AS (SELECT conv_id AS run_id, turn, role, greatest(1, floor(length(text) / 4)) AS tokens FROM conversations),
calls AS (SELECT run_id, turn, 'synthesizer' AS model_role,
  CAST(coalesce(sum(tokens) OVER (PARTITION BY run_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS input_tokens,
  CAST(tokens AS BIGINT) AS output_tokens, role FROM d)"""


@query("call_cost", f"""WITH {DIALOG_SQL}
SELECT run_id, turn, input_tokens, output_tokens,
  round((input_tokens * 5.0 + output_tokens * 25.0) / 1e6, 9) AS cost_usd FROM calls WHERE role = 'assistant'""")
def q_call_cost(spark, sf):
    """Assistant turns as model calls: input = all earlier turns of the dialogue,
    output = the turn itself, priced by the synthesizer role."""
    from ..operators.relational import ranked_within
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text") \
        .withColumn("tok", token_estimate("text"))
    # tokens of all earlier turns: a skew-safe prefix sum per dialogue
    cum = ranked_within(c.select("conv_id", "turn", "role", "tok"), ["conv_id"], ["turn"], sum_col="tok",
                        cum_col="input_tokens")
    calls = cum.select(F.col("conv_id").alias("run_id"), "turn", F.col("role").alias("speaker"),
                       F.col("input_tokens").cast("bigint").alias("input_tokens"),
                       F.col("tok").alias("output_tokens"),
                       # model role of the call: assistant turns are synthesizer calls
                       F.when(F.col("role") == "assistant", "synthesizer").alias("role")) \
        .where(F.col("speaker") == "assistant")
    prices = spark.createDataFrame(PRICES, "role string, price_in double, price_out double")
    return R.call_cost(calls, prices).select("run_id", "turn", "input_tokens", "output_tokens", "cost_usd")


@query("required_attributes", f"""{W}, u AS (
  SELECT run_id, 'tool.name' AS attribute, tool IS NOT NULL AS has FROM steps UNION ALL
  SELECT run_id, 'tool.args_hash', args_hash IS NOT NULL FROM steps UNION ALL
  SELECT run_id, 'cost.usd', cost_usd IS NOT NULL FROM steps UNION ALL
  SELECT run_id, 'agent.role', role IS NOT NULL FROM steps UNION ALL
  SELECT run_id, 'validation.passed', passed IS NOT NULL FROM steps UNION ALL
  SELECT run_id, 'context.bundle_tokens', bundle_tokens IS NOT NULL FROM steps UNION ALL
  SELECT run_id, 'result_ref', result_ref IS NOT NULL FROM steps UNION ALL
  SELECT run_id, unnest(['subtask.id', 'model.id', 'cassette.mode']), false FROM steps)
SELECT run_id, attribute AS missing_attribute FROM u GROUP BY run_id, attribute HAVING NOT bool_or(has)""")
def q_required_attributes(spark, sf):
    """The bound spans name no subtask, model or recording mode, so these are missing."""
    return R.required_attributes(B.spans_from_events(spark, sf))


@query("retrieval_attributes", """WITH v AS (SELECT user_id AS run_id, CAST(event_id AS VARCHAR) AS span_id,
  CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'view')
SELECT run_id, span_id, 'retrieval.corpus_version' AS missing_attribute FROM v WHERE k <= 5
UNION ALL SELECT run_id, span_id, 'retrieval.scores' FROM v WHERE k % 10 = 0
UNION ALL SELECT run_id, span_id, 'retrieval.doc_ids' FROM v WHERE k % 15 = 0""")
def q_retrieval_attributes(spark, sf):
    """Views are lookups; some lack their corpus version, scores or documents."""
    return R.retrieval_attributes(B.spans_from_events(spark, sf))


@query("args_hash", """SELECT event_id, left(sha256('{"args":{"k":' || json_extract(props, '$.k') || ',"tags":["' || event_type || '",null]},"tool":"'
  || CASE WHEN user_id % 2 = 0 THEN 'caf\\u00e9' ELSE event_type END || '"}'), 16) AS args_hash,
  left(sha256(replace(props, ' ', '')), 16) AS props_hash FROM events""")
def q_args_hash(spark, sf):
    """One payload per event, its keys (nested ones too) in an order that varies with the
    event and with blanks here and there: the hash must not see either."""
    e = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    k, tool = F.get_json_object("props", "$.k"), F.when(F.col("user_id") % 2 == 0, "caf\u00e9").otherwise(F.col("event_type"))
    args = F.when(F.col("event_id") % 3 == 0, F.format_string('{"k": %s, "tags": ["%s", null]}', k, F.col("event_type"))) \
        .otherwise(F.format_string('{"tags":["%s",null],\n "k":%s}', F.col("event_type"), k))
    payload = F.when(F.col("event_id") % 2 == 0, F.format_string('{"tool":"%s","args":%s}', tool, args)) \
        .otherwise(F.format_string('{ "args": %s, "tool" : "%s" }', args, tool))
    return e.select("event_id", args_hash(payload).alias("args_hash"), args_hash("props").alias("props_hash"))


def answers_sql(events: str = "events", p: str = "") -> str:
    return f"""{p}ans AS (SELECT user_id AS run_id, 'purchase_path' AS task_id,
  CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS produced0,
  CAST(count(DISTINCT props) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS expected,
  bool_or(event_type = 'signup') AS has_signup
  FROM {events} GROUP BY user_id),
{p}ts AS (SELECT run_id, task_id, CASE WHEN produced0 > 0 THEN produced0 END AS produced, expected, 0.0::DOUBLE AS tolerance,
  CASE WHEN has_signup THEN 'verified' ELSE 'draft' END AS status FROM {p}ans),
{p}succ AS (SELECT run_id, task_id, produced, expected, tolerance, status,
  CASE WHEN produced IS NULL THEN 0.0 WHEN abs(produced - expected) <= tolerance THEN 1.0 ELSE 0.0 END::DOUBLE AS score,
  coalesce(abs(produced - expected) <= tolerance, false) AND status = 'verified' AS passed,
  CASE WHEN produced IS NULL THEN 'no numeric answer'
       WHEN abs(produced - expected) <= tolerance AND status <> 'verified' THEN 'matches a draft ground truth'
       WHEN abs(produced - expected) <= tolerance THEN 'within tolerance' ELSE 'outside tolerance' END AS detail FROM {p}ts)"""


ANSWERS_SQL = answers_sql()


def _success(spark, sf, since=None, until=None):
    """Per run the answer is the naive row count of its purchase events; the ground
    truth is the count of distinct purchases (the dedupe trap).  A run whose user
    never signed up has only a draft truth, which can be scored but never pass."""
    e = read_table(spark, sf, "events", "user_id", "event_type", "props", "ts")
    if since:
        e = e.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        e = e.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    p = F.col("event_type") == "purchase"
    a = e.groupBy("user_id").agg(F.count_if(p).cast("double").alias("n"),
                                 F.count_distinct(F.when(p, F.col("props"))).cast("double").alias("expected"),
                                 F.bool_or(F.col("event_type") == "signup").alias("has_signup"))
    answers = a.select(F.col("user_id").alias("run_id"), F.lit(TASK["task_id"]).alias("task_id"),
                       F.when(F.col("n") > 0, F.col("n")).alias("produced"), "expected", "has_signup")
    tasks = answers.select("run_id", "task_id", "expected", F.lit(0.0).alias("tolerance"),
                           F.when(F.col("has_signup"), "verified").otherwise("draft").alias("status"))
    # the ground truth is per run here, so the task table is keyed by (run, task)
    return R.task_success(answers.drop("expected", "has_signup"), tasks, keys=["run_id", "task_id"])


@query("task_success", f"WITH {ANSWERS_SQL} SELECT * FROM succ")
def q_task_success(spark, sf):
    return _success(spark, sf)


SCORE_SQL = f"""{HISTORY_SQL}, {SPANS_SQL}, {ANSWERS_SQL},
scored AS (SELECT s.run_id, s.task_id, s.score, s.passed AND s.score >= 1.0 AS passed, m.steps, m.tool_calls, m.cost_usd,
  t.stale_reason,
  concat_ws('; ', CASE WHEN s.produced IS NULL THEN 'no numeric answer' END,
    CASE WHEN m.validation_failures > 0 THEN CAST(m.validation_failures AS VARCHAR) || ' validation failure(s)' END,
    CASE WHEN s.score < 1.0 THEN 'task_success below the floor' END) AS notes
  FROM succ s LEFT JOIN summary m ON s.run_id = m.run_id LEFT JOIN stale t ON s.run_id = t.run_id)"""


def _scored(spark, sf):
    """Scores with the staleness of each run by the versions at its start."""
    return R.score_runs(_success(spark, sf), R.run_summary(_steps(spark, sf)), staleness(run_verdicts(spark, sf)))


@query("score_runs", f"{SCORE_SQL} SELECT * FROM scored")
def q_score_runs(spark, sf):
    return _scored(spark, sf)


@query("gate_verdict", f"""{SCORE_SQL} SELECT run_id, CASE WHEN passed THEN 'PASS' WHEN stale_reason IS NOT NULL THEN 'STALE'
  ELSE 'FAIL' END AS verdict FROM scored""")
def q_gate_verdict(spark, sf):
    return R.gate_verdict(_scored(spark, sf))


@query("citation_check", """WITH res AS (SELECT user_id AS run_id, 'ref-' || CAST(event_id AS VARCHAR) AS ref FROM events
  WHERE event_type NOT IN ('error', 'view')),
cit AS (SELECT user_id AS run_id, 'ref-' || CAST(event_id AS VARCHAR) AS ref FROM events WHERE event_type IN ('purchase', 'error')),
nr AS (SELECT run_id, count(*) AS n_results FROM res GROUP BY 1),
nc AS (SELECT run_id, count(*) AS n_cited FROM cit GROUP BY 1),
nd AS (SELECT run_id, count(*) AS n_dangling FROM cit WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.run_id = cit.run_id AND res.ref = cit.ref) GROUP BY 1),
j AS (SELECT coalesce(nr.run_id, nc.run_id) AS run_id, coalesce(n_results, 0) AS n_results, coalesce(n_cited, 0) AS n_cited
  FROM nr FULL JOIN nc ON nr.run_id = nc.run_id)
SELECT j.run_id, n_results, n_cited, coalesce(n_dangling, 0) AS n_dangling,
  coalesce(n_dangling, 0) = 0 AND NOT (n_cited = 0 AND n_results > 0) AS citations_ok FROM j LEFT JOIN nd ON j.run_id = nd.run_id""")
def q_citation_check(spark, sf):
    """Results = refs of successful tool calls; the answer cites purchases and errors
    (errors returned no result, so citing them dangles)."""
    e = read_table(spark, sf, "events", "user_id", "event_id", "event_type")
    ref = F.concat(F.lit("ref-"), F.col("event_id").cast("string"))
    res = e.where(~F.col("event_type").isin("error", "view")).select(F.col("user_id").alias("run_id"), ref.alias("ref"))
    cit = e.where(F.col("event_type").isin("purchase", "error")).select(F.col("user_id").alias("run_id"), ref.alias("ref"))
    return R.citation_check(res, cit)


# Fixed rules of the bound plans: what each kind of event waits for, and further edges.
DEPS = {"purchase": "click", "click": "view", "error": "signup"}
EDGES = [("view", "signup"), ("signup", "purchase"), ("purchase", "refund")]
DEEPEST = 5                      # kinds of events, so no chain of them is longer

PLAN_SQL = """st AS (SELECT DISTINCT user_id AS run_id, event_type AS subtask_id FROM events WHERE user_id % 4 <> 0
  UNION ALL SELECT user_id, event_type FROM events WHERE user_id % 4 = 0),
dp AS (SELECT DISTINCT run_id, subtask_id, CASE subtask_id WHEN 'purchase' THEN 'click' WHEN 'click' THEN 'view'
  WHEN 'error' THEN 'signup' END AS depends_on FROM st),
kinds AS (SELECT user_id AS run_id, event_type AS kind, min(ts) AS first_ts FROM events GROUP BY 1, 2),
ed AS (SELECT run_id, src, dst FROM (SELECT DISTINCT run_id FROM st), (VALUES ('view', 'signup'), ('signup', 'purchase')) e(src, dst)
  UNION ALL SELECT run_id, 'purchase', 'refund' FROM kinds WHERE kind = 'purchase' AND run_id % 3 = 0
  UNION ALL SELECT a.run_id, 'error', 'click' FROM kinds a JOIN kinds b ON a.run_id = b.run_id AND a.kind = 'error' AND b.kind = 'click'
    WHERE a.first_ts < b.first_ts
  UNION ALL SELECT a.run_id, 'purchase', 'view' FROM kinds a JOIN kinds b ON a.run_id = b.run_id AND a.kind = 'purchase' AND b.kind = 'view'
    WHERE a.first_ts < b.first_ts),
links AS (SELECT DISTINCT l.run_id, l.src, l.dst FROM (SELECT run_id, depends_on AS src, subtask_id AS dst FROM dp WHERE depends_on IS NOT NULL
    UNION ALL SELECT * FROM ed) l
  WHERE EXISTS (SELECT 1 FROM st WHERE st.run_id = l.run_id AND st.subtask_id = l.src)
    AND EXISTS (SELECT 1 FROM st WHERE st.run_id = l.run_id AND st.subtask_id = l.dst)),
paths AS (SELECT DISTINCT run_id, subtask_id, 0 AS len FROM st
  UNION SELECT l.run_id, l.dst, len + 1 FROM paths p JOIN links l ON l.run_id = p.run_id AND l.src = p.subtask_id WHERE len < 5),
layers AS (SELECT run_id, subtask_id, CASE WHEN max(len) < 5 THEN CAST(max(len) AS INTEGER) END AS layer FROM paths GROUP BY 1, 2)"""


def _plans(spark, sf):
    """Plan per run: its kinds of events as subtasks (in every fourth run an event each, so
    that ids repeat), the fixed dependencies, the fixed edges (a diamond from view to purchase), one to a subtask that the plan lacks for
    every third run, and one back where an error came before the first click, or a
    purchase before the first view: that closes a cycle."""
    e = read_table(spark, sf, "events", "user_id", "event_type", "ts").withColumnRenamed("user_id", "run_id")
    st = e.select("run_id", F.col("event_type").alias("subtask_id"))
    st = st.where(F.col("run_id") % 4 != 0).distinct().unionByName(st.where(F.col("run_id") % 4 == 0))
    dep = F.create_map(*[F.lit(x) for kv in DEPS.items() for x in kv])
    deps = st.distinct().select("run_id", "subtask_id", dep[F.col("subtask_id")].alias("depends_on")) \
        .where(F.col("depends_on").isNotNull())
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    at = e.groupBy("run_id").agg(*[first(k).alias(k) for k in ("view", "click", "purchase", "error")])
    edge = lambda a, b: F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"))
    edges = at.select("run_id", F.explode(F.filter(F.array(
        edge(*EDGES[0]), edge(*EDGES[1]), F.when(F.col("purchase").isNotNull() & (F.col("run_id") % 3 == 0), edge(*EDGES[2])),
        F.when(F.col("error") < F.col("click"), edge("error", "click")),
        F.when(F.col("purchase") < F.col("view"), edge("purchase", "view"))), lambda x: x.isNotNull())).alias("e")).select("run_id", "e.*")
    return st, deps, edges


@query("plan_integrity", f"""WITH RECURSIVE {PLAN_SQL},
dup AS (SELECT run_id, count(*) AS n_duplicate_ids FROM (SELECT run_id, subtask_id FROM st GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
un AS (SELECT run_id, count(*) AS n_unresolved FROM dp WHERE depends_on IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM st WHERE st.run_id = dp.run_id AND st.subtask_id = dp.depends_on) GROUP BY 1),
ue AS (SELECT run_id, count(*) AS n_unresolved_edges FROM ed WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.run_id = ed.run_id AND st.subtask_id = ed.src)
  OR NOT EXISTS (SELECT 1 FROM st WHERE st.run_id = ed.run_id AND st.subtask_id = ed.dst) GROUP BY 1),
cy AS (SELECT run_id, count(*) AS n_cyclic FROM layers WHERE layer IS NULL GROUP BY 1),
r AS (SELECT DISTINCT run_id FROM st)
SELECT r.run_id, coalesce(n_duplicate_ids, 0) AS n_duplicate_ids, coalesce(n_unresolved, 0) AS n_unresolved,
  coalesce(n_unresolved_edges, 0) AS n_unresolved_edges, coalesce(n_cyclic, 0) AS n_cyclic,
  coalesce(n_duplicate_ids, 0) = 0 AND coalesce(n_unresolved, 0) = 0 AND coalesce(n_unresolved_edges, 0) = 0 AND coalesce(n_cyclic, 0) = 0 AS plan_ok
FROM r LEFT JOIN dup ON r.run_id = dup.run_id LEFT JOIN un ON r.run_id = un.run_id LEFT JOIN ue ON r.run_id = ue.run_id
LEFT JOIN cy ON r.run_id = cy.run_id""")
def q_plan_integrity(spark, sf):
    return R.plan_integrity(*_plans(spark, sf))


@query("plan_layers", f"WITH RECURSIVE {PLAN_SQL} SELECT * FROM layers")
def q_plan_layers(spark, sf):
    st, deps, edges = _plans(spark, sf)
    known = st.distinct()
    links = edges.unionByName(deps.select("run_id", F.col("depends_on").alias("src"), F.col("subtask_id").alias("dst")))
    for end in ("src", "dst"):
        links = links.join(known.withColumnRenamed("subtask_id", end), ["run_id", end], "left_semi")
    return R.plan_layers(st, links)


@query("assumption_check", """SELECT user_id AS run_id, event_id AS result_id, round(least(value / 40.0, 1.0), 9) AS confidence
FROM events WHERE event_type = 'purchase' AND round(least(value / 40.0, 1.0), 9) < 0.8
  AND CAST(json_extract(props, '$.k') AS BIGINT) <= 50""")
def q_assumption_check(spark, sf):
    """Purchases as results: confidence from the value, assumptions from the props
    payload (present when k > 50)."""
    e = read_table(spark, sf, "events", "user_id", "event_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    res = e.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("result_id"),
        F.round(F.least(F.col("value") / 40.0, F.lit(1.0)), 9).alias("confidence"),
        F.when(k > 50, F.array(F.col("props"))).otherwise(F.array().cast("array<string>")).alias("assumptions"))
    return R.assumption_check(res)


@query("tool_call_accuracy", f"""{W}, u AS (SELECT run_id, list_sort(list(DISTINCT tool)) AS tools FROM ordered
  WHERE tool <> '' GROUP BY run_id)
SELECT run_id, round(len(list_intersect(tools, ['view', 'click', 'purchase']))::DOUBLE / nullif(len(tools), 0), 9) AS precision,
  round(len(list_intersect(tools, ['view', 'click', 'purchase']))::DOUBLE / 3.0, 9) AS recall,
  len(list_intersect(tools, ['error'])) AS forbidden_used FROM u""")
def q_tool_call_accuracy(spark, sf):
    used = _steps(spark, sf).where(R.uses_tool()).select("run_id", "tool")
    return R.tool_call_accuracy(used, TASK)


@query("required_order", f"""{W}, first AS (SELECT run_id, tool, min(step_no) AS f FROM ordered WHERE tool IS NOT NULL GROUP BY 1, 2),
grid AS (SELECT DISTINCT run_id, p.a, p.b FROM ordered, (VALUES ('view', 'purchase'), ('click', 'purchase')) p(a, b))
SELECT g.run_id, g.a, g.b, coalesce(fa.f < fb.f, false) AS in_order FROM grid g
LEFT JOIN first fa ON fa.run_id = g.run_id AND fa.tool = g.a LEFT JOIN first fb ON fb.run_id = g.run_id AND fb.tool = g.b""")
def q_required_order(spark, sf):
    return R.required_order(_steps(spark, sf), TASK["required_order"])


@query("must_cite", """WITH c AS (SELECT user_id AS run_id, list(DISTINCT 'doc-' || event_type) AS cited
  FROM events WHERE event_type IN ('purchase', 'click', 'signup') GROUP BY 1)
SELECT run_id, array_to_string(list_sort(list_filter(['doc-purchase', 'doc-signup'], lambda x: NOT list_contains(cited, x))), ',') AS missing,
  len(list_filter(['doc-purchase', 'doc-signup'], lambda x: NOT list_contains(cited, x))) = 0 AS ok FROM c""")
def q_must_cite(spark, sf):
    """Required documents doc-purchase and doc-signup; a run cites the document of
    each purchase, click or signup it made."""
    e = read_table(spark, sf, "events", "user_id", "event_type").where(
        F.col("event_type").isin("purchase", "click", "signup"))
    cited = e.select(F.col("user_id").alias("run_id"), F.concat(F.lit("doc-"), F.col("event_type")).alias("doc_id"))
    return R.must_cite(cited, TASK["must_cite"])


@query("arg_correctness", """WITH cand AS (SELECT user_id AS run_id, event_type, props FROM events),
ref AS (SELECT DISTINCT user_id AS run_id, event_type, props FROM events),
d AS (SELECT * FROM cand EXCEPT ALL SELECT * FROM ref)
SELECT run_id, count(*) AS n_extra_rows FROM d GROUP BY 1""")
def q_arg_correctness(spark, sf):
    """Candidate result (every row) against the reference result (distinct rows),
    compared by executing both: the multiset difference per run."""
    from ..operators.relational import result_diff
    e = read_table(spark, sf, "events", "user_id", "event_type", "props").withColumnRenamed("user_id", "run_id")
    d = result_diff(e, e.distinct())
    return d.where(F.col("only_in") == "left").groupBy("run_id").agg(F.count("*").alias("n_extra_rows"))


@query("trajectory_efficiency", f"""{W} SELECT run_id, round(steps::DOUBLE / 3.0, 9) AS efficiency,
  round(repeated_calls::DOUBLE / nullif(steps, 0), 9) AS redundant_rate FROM summary""")
def q_trajectory_efficiency(spark, sf):
    return R.trajectory_efficiency(R.run_summary(_steps(spark, sf)), TASK["min_steps"])


@query("loop_rate", f"""{W}, x AS (SELECT run_id, count(*) OVER (PARTITION BY run_id, tool, args_hash ORDER BY step_no
  RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) > 0 AS in_loop FROM ordered WHERE name = 'tool.call'),
p AS (SELECT run_id, bool_or(in_loop) AS looped FROM x GROUP BY 1)
SELECT count(*) AS n_runs, count(*) FILTER (WHERE looped) AS n_looped, round(avg(CASE WHEN looped THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS loop_rate FROM p""")
def q_loop_rate(spark, sf):
    return R.loop_rate(R.trajectory_order(_steps(spark, sf).select(*LOOP_COLUMNS)), 5)


@query("recovery_rate", f"""{W}, f AS (SELECT run_id, min(step_no) AS f FROM ordered WHERE passed = false GROUP BY 1),
p AS (SELECT o.run_id, bool_or(step_no > f) AS detected, bool_or(step_no > f AND name = 'node') AS replanned,
  bool_or(step_no > f AND tool = 'purchase') AS succeeded FROM ordered o JOIN f ON o.run_id = f.run_id GROUP BY 1)
SELECT count(*) AS n_failed_runs, round(avg(CASE WHEN detected THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS detected_rate,
  round(avg(CASE WHEN replanned THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS replanned_rate,
  round(avg(CASE WHEN succeeded THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS recovery_rate FROM p""")
def q_recovery_rate(spark, sf):
    return R.recovery_rate(_steps(spark, sf), "purchase")


@query("transfer_integrity", f"""{W}, calls AS (SELECT * FROM ordered WHERE name = 'tool.call'),
fv AS (SELECT run_id, round(avg(CASE WHEN passed IS NOT NULL THEN CASE WHEN passed THEN 1.0 ELSE 0.0 END END)::DOUBLE, 9) AS first_time_valid
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, tool, args_hash ORDER BY step_no) AS k FROM calls) WHERE k = 1 GROUP BY 1),
ro AS (SELECT run_id, count(*) FILTER (WHERE nr > 1) AS cross_role_repeats FROM (
  SELECT run_id, tool, args_hash, count(DISTINCT role) AS nr FROM calls GROUP BY 1, 2, 3) GROUP BY 1),
pv AS (SELECT run_id, count(*) FILTER (WHERE result_ref IS NULL) AS no_provenance FROM calls GROUP BY 1)
SELECT coalesce(fv.run_id, ro.run_id, pv.run_id) AS run_id, first_time_valid, cross_role_repeats, no_provenance
FROM fv FULL JOIN ro ON fv.run_id = ro.run_id FULL JOIN pv ON coalesce(fv.run_id, ro.run_id) = pv.run_id""")
def q_transfer_integrity(spark, sf):
    return R.transfer_integrity(_steps(spark, sf))


@query("latency_quantiles", f"""{W} SELECT tool, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM steps WHERE tool IS NOT NULL GROUP BY 1""")
def q_latency_quantiles(spark, sf):
    return R.latency_quantiles(_steps(spark, sf))


# Fixed periods: the metrics of the later are held against those of the earlier.
GATE_SPLIT = "2024-01-16 00:00:00"
GATE_TOLERANCE = 0.02


def gate_sql(p: str, events: str) -> str:
    """The five metrics over the events of a period, as CTE ``{p}metrics``."""
    return f"""{spans_sql(events, p)}, {answers_sql(events, p)},
{p}used AS (SELECT run_id, list_sort(list(DISTINCT tool)) AS tools FROM {p}ordered WHERE tool <> '' GROUP BY run_id),
{p}looped AS (SELECT run_id, bool_or(in_loop) AS looped FROM (SELECT run_id, count(*) OVER (PARTITION BY run_id, tool, args_hash ORDER BY step_no
  RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) > 0 AS in_loop FROM {p}ordered WHERE name = 'tool.call') GROUP BY 1),
{p}failed AS (SELECT run_id, min(step_no) AS f FROM {p}ordered WHERE passed = false GROUP BY 1),
{p}recovered AS (SELECT o.run_id, bool_or(step_no > f AND tool = 'purchase') AS ok FROM {p}ordered o JOIN {p}failed f ON o.run_id = f.run_id GROUP BY 1),
{p}metrics AS (SELECT 'task_success' AS metric, round(avg(score), 9) AS value FROM {p}succ
  UNION ALL SELECT 'efficiency', round(avg(round(steps::DOUBLE / 3.0, 9)), 9) FROM {p}summary
  UNION ALL SELECT 'tool_accuracy', round(avg((round(len(list_intersect(tools, ['view', 'click', 'purchase']))::DOUBLE / len(tools), 9)
    + round(len(list_intersect(tools, ['view', 'click', 'purchase']))::DOUBLE / 3.0, 9)) / 2), 9) FROM {p}used
  UNION ALL SELECT 'loop_rate', round(avg(CASE WHEN looped THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) FROM {p}looped
  UNION ALL SELECT 'recovery_rate', round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) FROM {p}recovered)"""


def _gate_metrics(spark, sf, since=None, until=None):
    steps = R.span_steps(B.spans_from_events(spark, sf, since, until))
    used = steps.where(R.uses_tool()).select("run_id", "tool")
    return R.gate_metrics(_success(spark, sf, since, until), R.tool_call_accuracy(used, TASK),
                          R.trajectory_efficiency(R.run_summary(steps), TASK["min_steps"]),
                          R.loop_rate(R.trajectory_order(steps.select(*LOOP_COLUMNS)), 5), R.recovery_rate(steps, "purchase"))


@query("regression_gate", f"""WITH {gate_sql("b_", f"(SELECT * FROM events WHERE ts < TIMESTAMP '{GATE_SPLIT}')")},
{gate_sql("c_", f"(SELECT * FROM events WHERE ts >= TIMESTAMP '{GATE_SPLIT}')")},
f AS (SELECT * FROM (VALUES ('task_success', '>=', 0.85::DOUBLE), ('tool_accuracy', '>=', 0.90), ('efficiency', '<=', 1.5),
  ('loop_rate', '<=', 0.0), ('recovery_rate', '>=', 0.70)) t(metric, op, floor))
SELECT f.metric, m.value, f.op, f.floor, b.value AS baseline,
  coalesce(CASE WHEN f.op = '>=' THEN m.value >= f.floor ELSE m.value <= f.floor END, false) AS meets_floor,
  coalesce(round(CASE WHEN f.op = '>=' THEN b.value - m.value ELSE m.value - b.value END, 9) > {GATE_TOLERANCE}, false) AS regressed
FROM f LEFT JOIN c_metrics m ON m.metric = f.metric LEFT JOIN b_metrics b ON b.metric = f.metric""")
def q_regression_gate(spark, sf):
    """The later half of the month against the earlier."""
    return R.regression_gate(_gate_metrics(spark, sf, since=GATE_SPLIT), _gate_metrics(spark, sf, until=GATE_SPLIT), GATE_TOLERANCE) \
        .select("metric", "value", "op", "floor", "baseline", "meets_floor", "regressed")


@query("cohen_kappa", """WITH x AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 - toxic) AS agree,
  count(*) FILTER (WHERE quality = 1) AS a1, count(*) FILTER (WHERE 1 - toxic = 1) AS b1 FROM labels)
SELECT n, round(agree / n, 9) AS observed_agreement,
  round((a1 * b1 + (n - a1) * (n - b1)) / (n * n), 9) AS expected_agreement,
  round(((agree / n) - (a1 * b1 + (n - a1) * (n - b1)) / (n * n)) / (1 - (a1 * b1 + (n - a1) * (n - b1)) / (n * n)), 9) AS kappa FROM x""")
def q_cohen_kappa(spark, sf):
    lab = read_table(spark, sf, "labels", "quality", "toxic").select("quality", (1 - F.col("toxic")).alias("rater_b"))
    return R.cohen_kappa(lab, "quality", "rater_b")
