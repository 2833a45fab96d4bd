"""Run analytics: span logs -> ordered steps -> per-run summaries, scores and
verdicts, computed for every run at once (partitioned by ``run_id``).

Input of most functions is a *step* DataFrame (``span_steps``) with the columns
``run_id, span_id, parent_span_id, name, start_ns, end_ns, duration_ms, tool,
args_hash, cost_usd, input_tokens, output_tokens, bundle_tokens, passed, role,
result_ref``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import ranked_within

# Fixed values of the scoring rules.
STEP_SPANS = ("node", "tool.call")          # spans that count as steps
ROOT_SPAN = "run"
TASK_SUCCESS_FLOOR = 1.0
TARGET_FLOORS = (("task_success", ">=", 0.85), ("tool_accuracy", ">=", 0.90),
                 ("efficiency", "<=", 1.5), ("loop_rate", "<=", 0.0), ("recovery_rate", ">=", 0.70))
CONFIDENCE_NEEDS_ASSUMPTIONS = 0.8
REQUIRED_ATTRIBUTES = ("subtask.id", "agent.role", "tool.name", "tool.args_hash", "context.bundle_tokens", "result_ref",
                       "cost.usd", "model.id", "validation.passed", "cassette.mode")
RETRIEVAL_ATTRIBUTES = ("retrieval.strategy", "retrieval.k", "retrieval.latency_ms", "retrieval.scores",
                        "retrieval.corpus_version", "retrieval.backend", "retrieval.doc_ids")


def span_steps(spans: DataFrame) -> DataFrame:
    """Flat span record -> typed step; missing numbers become 0."""
    a = "attributes"
    return spans.select(
        "run_id", "span_id", "parent_span_id", "name",
        F.coalesce(F.col("start_time_ns"), F.lit(0)).alias("start_ns"),
        F.coalesce(F.col("end_time_ns"), F.lit(0)).alias("end_ns"),
        F.coalesce(F.col("duration_ms"), F.lit(0.0)).alias("duration_ms"),
        F.col(f"{a}.`tool.name`").alias("tool"), F.col(f"{a}.`tool.args_hash`").alias("args_hash"),
        F.coalesce(F.col(f"{a}.`cost.usd`"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.col(f"{a}.`gen_ai.usage.input_tokens`"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.col(f"{a}.`gen_ai.usage.output_tokens`"), F.lit(0)).alias("output_tokens"),
        F.col(f"{a}.`context.bundle_tokens`").alias("bundle_tokens"),
        F.col(f"{a}.`validation.passed`").alias("passed"),
        F.col(f"{a}.`agent.role`").alias("role"),
        F.col(f"{a}.result_ref").alias("result_ref"))


def trajectory_order(steps: DataFrame) -> DataFrame:
    """Steps numbered by start time (missing start = 0), ties by span id; skew-safe
    (a run holding a third of all spans is still spread over many tasks)."""
    return ranked_within(steps, ["run_id"], ["start_ns", "span_id"], rank_col="step_no")


def span_tree(steps: DataFrame) -> DataFrame:
    """Depth of every span below its run's root.  Each round doubles the distance that a
    span looks up (one equi-join on (run_id, span_id)), so a chain of any length takes
    log2 of it; a parent that is not in the run counts as one step.  A cycle never comes
    to an end and is an error."""
    from ..sources.files import materialise
    cur = materialise(steps.select("run_id", "span_id", F.col("parent_span_id").alias("anc"),
                                   F.col("parent_span_id").isNotNull().cast("int").alias("depth")), "span-tree")
    rounds = max(cur.count(), 1).bit_length() + 1
    while not cur.where(F.col("anc").isNotNull()).isEmpty():
        if rounds == 0:
            raise ValueError("the parents of some spans form a cycle")
        rounds -= 1
        up = cur.select("run_id", F.col("span_id").alias("anc"), F.col("anc").alias("next"), F.col("depth").alias("more"))
        cur = materialise(cur.join(up, ["run_id", "anc"], "left").select(
            "run_id", "span_id", F.col("next").alias("anc"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "span-tree")
    return cur.select("run_id", "span_id", "depth")


def uses_tool() -> F.Column:
    """A step of any kind that names a tool."""
    return F.coalesce(F.col("tool") != "", F.lit(False))


def repeatable() -> F.Column:
    return uses_tool() & F.coalesce(F.col("args_hash") != "", F.lit(False))


def tool_calls(steps: DataFrame) -> DataFrame:
    """The run's tool uses in step order, one row each (never collected into a list)."""
    return ranked_within(steps.where(uses_tool()).select("run_id", "start_ns", "span_id", "tool"), ["run_id"], ["start_ns", "span_id"],
                         rank_col="call_no").select("run_id", "call_no", "tool")


def repeated_calls(steps: DataFrame) -> DataFrame:
    """Every step after the first with the same (tool, args hash) in its run."""
    x = steps.where(repeatable()).select("run_id", "tool", "args_hash", "span_id", F.struct("start_ns", "span_id").alias("at"))
    first = x.groupBy("run_id", "tool", "args_hash").agg(F.min("at").alias("first"))
    return x.join(first, ["run_id", "tool", "args_hash"]).where(F.col("at") > F.col("first")).select("run_id", "span_id")


def run_totals(steps: DataFrame) -> DataFrame:
    """Steps, tool uses, validation failures, largest handoff and cost (the root span
    repeats the total and is left out; rounded to 6): one aggregation per run."""
    return steps.groupBy("run_id").agg(
        F.count_if(F.col("name").isin(*STEP_SPANS)).alias("steps"),
        F.count_if(uses_tool()).alias("tool_calls"),
        F.count_if(F.col("passed") == F.lit(False)).alias("validation_failures"),
        F.max(F.when(F.col("bundle_tokens") != 0, F.col("bundle_tokens"))).alias("max_bundle"),
        F.round(F.sum(F.when(F.coalesce(F.col("name") != ROOT_SPAN, F.lit(True)), F.col("cost_usd")).otherwise(0.0)), 6).alias("cost_usd"))


def run_summary(steps: DataFrame) -> DataFrame:
    """``run_totals`` and the number of repeats: uses of a (tool, args hash) less one each.
    The steps are gone through once: totals by call, then by run."""
    calls = steps.groupBy("run_id", "tool", "args_hash").agg(
        F.count("*").alias("n"), F.count_if(F.col("name").isin(*STEP_SPANS)).alias("steps"),
        F.count_if(F.col("passed") == F.lit(False)).alias("failures"),
        F.max(F.when(F.col("bundle_tokens") != 0, F.col("bundle_tokens"))).alias("bundle"),
        F.sum(F.when(F.coalesce(F.col("name") != ROOT_SPAN, F.lit(True)), F.col("cost_usd")).otherwise(0.0)).alias("cost"))
    return calls.groupBy("run_id").agg(
        F.sum("steps").alias("steps"), F.sum(F.when(uses_tool(), F.col("n")).otherwise(0)).alias("tool_calls"),
        F.sum("failures").alias("validation_failures"), F.max("bundle").alias("max_bundle"), F.round(F.sum("cost"), 6).alias("cost_usd"),
        F.sum(F.when(repeatable(), F.col("n") - 1).otherwise(0)).alias("repeated_calls"))


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """tokens x price per million by role.  ``prices``: role, price_in, price_out
    (one row per model role: a bounded dimension, broadcast)."""
    j = calls.join(F.broadcast(prices), "role")
    cost = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6
    return j.withColumn("cost_usd", F.round(cost, 9))


def _has(spans: DataFrame, name: str) -> F.Column:
    """Whether a span gives the attribute a value: by name in ``all_attributes`` where the
    spans carry it, else in the typed ones (a name that these lack has none)."""
    if "all_attributes" in spans.columns:
        return F.coalesce(F.col("all_attributes")[name].isNotNull(), F.lit(False))
    known = spans.schema["attributes"].dataType.fieldNames()
    return F.col(f"attributes.`{name}`").isNotNull() if name in known else F.lit(False)


def required_attributes(spans: DataFrame, required=REQUIRED_ATTRIBUTES) -> DataFrame:
    """Required attributes with no value anywhere in a run: one aggregation with a flag
    for each, unpivoted."""
    flags = spans.groupBy("run_id").agg(*[F.bool_or(_has(spans, k)).alias(f"_{i}") for i, k in enumerate(required)])
    missing = F.filter(F.array(*[F.when(~F.col(f"_{i}"), F.lit(k)) for i, k in enumerate(required)]), lambda x: x.isNotNull())
    return flags.select("run_id", F.explode(missing).alias("missing_attribute"))


def retrieval_attributes(spans: DataFrame, required=RETRIEVAL_ATTRIBUTES) -> DataFrame:
    """Of every span that performs a retrieval (it carries any attribute of that family)
    the required attributes without a value.  A span at a time, so no shuffle."""
    looked = F.exists(F.map_entries("all_attributes"), lambda e: e["key"].startswith("retrieval.") & e["value"].isNotNull())
    missing = F.filter(F.array(*[F.when(~_has(spans, k), F.lit(k)) for k in required]), lambda x: x.isNotNull())
    return spans.where(looked).select("run_id", "span_id", F.explode(missing).alias("missing_attribute"))


def task_success(answers: DataFrame, tasks: DataFrame, keys=("task_id",)) -> DataFrame:
    """Within tolerance passes; a missing answer fails; a draft ground truth is scored
    but never passes.  answers: run_id, task_id, produced; tasks: task_id, expected,
    tolerance, status."""
    j = answers.join(tasks, list(keys), "left")
    within = F.abs(F.col("produced") - F.col("expected")) <= F.col("tolerance")
    score = F.when(F.col("produced").isNull(), 0.0).when(within, 1.0).otherwise(0.0)
    passed = F.coalesce(within, F.lit(False)) & (F.col("status") == "verified")
    detail = (F.when(F.col("produced").isNull(), "no numeric answer")
              .when(within & (F.col("status") != "verified"), "matches a draft ground truth")
              .when(within, "within tolerance").otherwise("outside tolerance"))
    return j.select("run_id", "task_id", "produced", "expected", "tolerance", "status",
                    score.alias("score"), passed.alias("passed"), detail.alias("detail"))


def score_runs(success: DataFrame, summary: DataFrame, stale: DataFrame | None = None,
               floor: float = TASK_SUCCESS_FLOOR) -> DataFrame:
    """Join task success, trajectory summary and staleness; notes as one string."""
    j = success.join(summary, "run_id", "left")
    if stale is not None:
        j = j.join(stale, "run_id", "left")
    else:
        j = j.withColumn("stale_reason", F.lit(None).cast("string"))
    notes = F.concat_ws("; ", F.filter(F.array(
        F.when(F.col("produced").isNull(), F.lit("no numeric answer")),
        F.when(F.col("validation_failures") > 0, F.concat(F.col("validation_failures").cast("string"),
                                                           F.lit(" validation failure(s)"))),
        F.when(F.col("score") < floor, F.lit("task_success below the floor"))), lambda x: x.isNotNull()))
    return j.select("run_id", "task_id", "score", (F.col("passed") & (F.col("score") >= floor)).alias("passed"),
                    "steps", "tool_calls", "cost_usd", "stale_reason", notes.alias("notes"))


def gate_verdict(scored: DataFrame) -> DataFrame:
    v = F.when(F.col("passed"), "PASS").when(F.col("stale_reason").isNotNull(), "STALE").otherwise("FAIL")
    return scored.select("run_id", v.alias("verdict"))


def citation_check(results: DataFrame, cited: DataFrame) -> DataFrame:
    """results: run_id, ref; cited: run_id, ref.  Dangling citations (no such result
    in the run) and runs that cite nothing while results exist are failures."""
    dangling = cited.join(results, ["run_id", "ref"], "left_anti").groupBy("run_id") \
        .agg(F.count("*").alias("n_dangling"))
    n_cited = cited.groupBy("run_id").agg(F.count("*").alias("n_cited"))
    n_res = results.groupBy("run_id").agg(F.count("*").alias("n_results"))
    j = n_res.join(n_cited, "run_id", "full").join(dangling, "run_id", "left").fillna(
        0, ["n_results", "n_cited", "n_dangling"])
    ok = (F.col("n_dangling") == 0) & ~((F.col("n_cited") == 0) & (F.col("n_results") > 0))
    return j.select("run_id", "n_results", "n_cited", "n_dangling", ok.alias("citations_ok"))


def plan_integrity(subtasks: DataFrame, deps: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """subtasks: run_id, subtask_id; deps: run_id, subtask_id, depends_on; edges: run_id,
    src, dst.  Per run: duplicate ids, dependencies and edges that name no subtask of the
    plan, and subtasks that no order can reach because they are on a cycle or after one."""
    dup = subtasks.groupBy("run_id", "subtask_id").agg(F.count("*").alias("n")).where("n > 1") \
        .groupBy("run_id").agg(F.count("*").alias("n_duplicate_ids"))
    ids = subtasks.select("run_id", F.col("subtask_id").alias("id")).distinct()
    links = deps.select("run_id", F.lit("dep").alias("kind"), F.col("depends_on").alias("src"), F.col("subtask_id").alias("dst"))
    if edges is not None:
        links = links.unionByName(edges.select("run_id", F.lit("edge").alias("kind"), "src", "dst"))
    known = links.join(ids.withColumnRenamed("id", "src").withColumn("has_src", F.lit(True)), ["run_id", "src"], "left") \
        .join(ids.withColumnRenamed("id", "dst").withColumn("has_dst", F.lit(True)), ["run_id", "dst"], "left")
    resolved = F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()
    unres = known.groupBy("run_id").agg(F.count_if(~resolved & (F.col("kind") == "dep")).alias("n_unresolved"),
                                        F.count_if(~resolved & (F.col("kind") == "edge")).alias("n_unresolved_edges"))
    stuck = plan_layers(subtasks, known.where(resolved).select("run_id", "src", "dst")).where(F.col("layer").isNull()) \
        .groupBy("run_id").agg(F.count("*").alias("n_cyclic"))
    j = subtasks.select("run_id").distinct().join(dup, "run_id", "left").join(unres, "run_id", "left").join(stuck, "run_id", "left") \
        .fillna(0, ["n_duplicate_ids", "n_unresolved", "n_unresolved_edges", "n_cyclic"])
    return j.withColumn("plan_ok", (F.col("n_duplicate_ids") == 0) & (F.col("n_unresolved") == 0)
                        & (F.col("n_unresolved_edges") == 0) & (F.col("n_cyclic") == 0))


def plan_layers(subtasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, subtask_id, layer): the layer of each distinct subtask (run_id, subtask_id)
    under edges (run_id, src, dst) whose ends are subtasks, 0 for those that wait for
    nothing, else one more than the latest subtask waited for; null on a cycle or after one.

    Nodes without open parents are removed again and again, all runs at once.  A node
    carries its number of open parents, so a round joins only the edges of the nodes just
    removed and adds up what they open; an edge is looked at once in all, and the rounds
    are as many as the longest chain of any run."""
    from ..sources.files import materialise
    links = materialise(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct(), "plan-edges")
    parents = links.groupBy("run_id", F.col("dst").alias("subtask_id")).agg(F.count("*").alias("open"))
    todo = materialise(subtasks.select("run_id", "subtask_id").distinct().join(parents, ["run_id", "subtask_id"], "left")
                       .fillna(0, ["open"]), "plan-open")
    layers, layer = [], 0
    while True:
        ready = todo.where(F.col("open") == 0).select("run_id", "subtask_id")
        if ready.isEmpty():
            break
        layers.append(ready.withColumn("layer", F.lit(layer).cast("int")))
        opened = ready.join(links.withColumnRenamed("src", "subtask_id"), ["run_id", "subtask_id"]) \
            .groupBy("run_id", F.col("dst").alias("subtask_id")).agg(F.count("*").alias("n"))
        todo = materialise(todo.where(F.col("open") > 0).join(opened, ["run_id", "subtask_id"], "left")
                           .select("run_id", "subtask_id", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open")), "plan-open")
        layer += 1
    stuck = todo.select("run_id", "subtask_id", F.lit(None).cast("int").alias("layer"))
    return reduce(DataFrame.unionByName, [*layers, stuck])


def assumption_check(results: DataFrame, threshold: float = CONFIDENCE_NEEDS_ASSUMPTIONS) -> DataFrame:
    """Results below the confidence threshold must state at least one assumption."""
    bad = (F.col("confidence") < threshold) & (F.coalesce(F.size("assumptions"), F.lit(0)) <= 0)
    return results.where(bad).select("run_id", "result_id", "confidence")


def tool_call_accuracy(used: DataFrame, task: dict) -> DataFrame:
    """Precision / recall of the run's distinct tools against the required set, and
    forbidden tools used.  The distinct-tool set per run is bounded by the number
    of tool kinds."""
    req = F.array(*[F.lit(t) for t in task["required_tools"]])
    forb = F.array(*[F.lit(t) for t in task["forbidden_tools"]])
    s = used.groupBy("run_id").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    hit = F.size(F.array_intersect("tools", req))
    return s.select("run_id",
                    F.round(F.try_divide(hit.cast("double"), F.size("tools").cast("double")), 9).alias("precision"),
                    F.round(hit.cast("double") / F.lit(float(len(task["required_tools"]))), 9).alias("recall"),
                    F.size(F.array_intersect("tools", forb)).alias("forbidden_used"))


def required_order(steps: DataFrame, pairs) -> DataFrame:
    """Each required pair (a, b) for every run: the first a comes before the first b
    (a missing tool fails the pair).  One aggregation: the first use of each tool named
    in a pair, by (start, span id)."""
    at = F.struct("start_ns", "span_id")
    tools = sorted({t for p in pairs for t in p})
    first = steps.groupBy("run_id").agg(*[F.min(F.when(F.col("tool") == t, at)).alias(f"first_{i}") for i, t in enumerate(tools)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                     F.coalesce(F.col(f"first_{tools.index(a)}") < F.col(f"first_{tools.index(b)}"), F.lit(False)).alias("in_order"))
            for a, b in pairs]
    return first.select("run_id", F.explode(F.array(*rows)).alias("p")).select("run_id", "p.a", "p.b", "p.in_order")


def must_cite(cited_docs: DataFrame, required) -> DataFrame:
    """Which of the required documents a run does not cite: one flag for each of them."""
    flags = cited_docs.groupBy("run_id").agg(*[F.bool_or(F.coalesce(F.col("doc_id") == d, F.lit(False))).alias(f"has_{i}")
                                               for i, d in enumerate(required)])
    missing = F.array_sort(F.filter(F.array(*[F.when(~F.col(f"has_{i}"), F.lit(d)) for i, d in enumerate(required)]), lambda x: x.isNotNull()))
    return flags.select("run_id", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("ok"))


def trajectory_efficiency(summary: DataFrame, min_steps: int) -> DataFrame:
    return summary.select(
        "run_id", F.round(F.col("steps").cast("double") / F.lit(float(min_steps)), 9).alias("efficiency"),
        F.round(F.try_divide(F.col("repeated_calls").cast("double"), F.col("steps").cast("double")), 9)
         .alias("redundant_rate"))


def loop_rate(ordered: DataFrame, width: int = 5) -> DataFrame:
    """Share of runs with a call repeating one of the previous ``width`` steps (``ordered``:
    run_id, name, tool, args_hash and step_no, which no two steps of a run share).

    Blocks of ``width`` steps: two equal calls of one block are near enough, those of
    neighbouring blocks if the first of the later is near the last of the earlier, others
    never.  So a call counts in its block and as the one before the next, and one
    aggregation, combined before the shuffle, tells for each (call, block)."""
    block = F.floor(F.col("step_no") / width)
    ends = ordered.where(F.col("name") == "tool.call").select("run_id", "tool", "args_hash", "step_no", F.explode(F.array(
        F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own")))).alias("at"))
    own = F.col("at.own")
    near = ends.groupBy("run_id", "tool", "args_hash", F.col("at.block").alias("block")).agg(
        F.count_if(own).alias("n"), F.min(F.when(own, F.col("step_no"))).alias("first"), F.max(F.when(~own, F.col("step_no"))).alias("before"))
    in_loop = (F.col("n") > 1) | F.coalesce(F.col("first") - F.col("before") <= width, F.lit(False))
    per_run = near.groupBy("run_id").agg(F.bool_or(in_loop).alias("looped"))
    return per_run.agg(F.count("*").alias("n_runs"), F.count_if("looped").alias("n_looped"),
                       F.round(F.avg(F.col("looped").cast("double")), 9).alias("loop_rate"))


def recovery_rate(steps: DataFrame, success_tool: str) -> DataFrame:
    """After the first failure of a run: detected (a later step exists), replanned
    (a later 'node' step) and succeeded (a later successful call).  The last step of each
    kind tells, so one aggregation per run does."""
    at = F.struct("start_ns", "span_id")
    per = steps.groupBy("run_id").agg(
        F.min(F.when(F.col("passed") == F.lit(False), at)).alias("f"), F.max(at).alias("last"),
        F.max(F.when(F.col("name") == "node", at)).alias("node"),
        F.max(F.when(F.col("tool") == success_tool, at)).alias("success")).where(F.col("f").isNotNull())
    later = lambda c: F.coalesce(F.col(c) > F.col("f"), F.lit(False)).cast("double")
    return per.agg(F.count("*").alias("n_failed_runs"),
                   F.round(F.avg(later("last")), 9).alias("detected_rate"),
                   F.round(F.avg(later("node")), 9).alias("replanned_rate"),
                   F.round(F.avg(later("success")), 9).alias("recovery_rate"))


def transfer_integrity(steps: DataFrame) -> DataFrame:
    """Per run: share of validated calls that passed on their first attempt, the same
    (tool, args) called by more than one role, and results without provenance.  Two
    aggregations, by call and by run."""
    calls = steps.where(F.col("name") == "tool.call").groupBy("run_id", "tool", "args_hash").agg(
        F.min_by(F.struct("passed"), F.struct("start_ns", "span_id"))["passed"].alias("passed"),
        (F.min("role") < F.max("role")).alias("several"),
        F.count_if(F.col("result_ref").isNull()).alias("none"))
    return calls.groupBy("run_id").agg(
        F.round(F.avg(F.col("passed").cast("double")), 9).alias("first_time_valid"),
        F.count_if("several").alias("cross_role_repeats"), F.sum("none").alias("no_provenance"))


def latency_quantiles(steps: DataFrame, key: str = "tool") -> DataFrame:
    """p50 / p95 of span durations per key, exact and without buffering a key's
    durations in one task (``exact_percentiles``)."""
    from .relational import exact_percentiles
    return exact_percentiles(steps.where(F.col(key).isNotNull()), [key], "duration_ms",
                             {"p50_ms": 0.5, "p95_ms": 0.95})


def tool_accuracy(accuracy: DataFrame) -> DataFrame:
    """Mean over runs of the mean of precision and recall; no tool used counts as 0."""
    return accuracy.agg(F.round(F.avg((F.coalesce("precision", F.lit(0.0)) + F.col("recall")) / 2), 9).alias("tool_accuracy"))


def gate_metrics(success: DataFrame, accuracy: DataFrame, efficiency: DataFrame, loops: DataFrame, recovery: DataFrame) -> DataFrame:
    """(metric, value): the metrics of the gate, each from its operator's result."""
    one = {"task_success": success.agg(F.avg("score").alias("v")), "tool_accuracy": tool_accuracy(accuracy),
           "efficiency": efficiency.agg(F.avg("efficiency").alias("v")), "loop_rate": loops.select("loop_rate"),
           "recovery_rate": recovery.select("recovery_rate")}
    return reduce(DataFrame.unionByName, [df.select(F.lit(m).alias("metric"), F.round(F.col(df.columns[0]), 9).alias("value"))
                                          for m, df in one.items()])


def regression_gate(metrics: DataFrame, baseline: DataFrame | None = None, tolerance: float = 0.0,
                    floors=TARGET_FLOORS) -> DataFrame:
    """metrics: metric, value.  One row for each floor: a metric without a value misses it.
    With a baseline also whether the metric is worse than there by more than
    ``tolerance``: lower where the floor is a least value, higher where it is a greatest."""
    spark = metrics.sparkSession
    f = spark.createDataFrame([(m, op, float(v)) for m, op, v in floors], "metric string, op string, floor double")
    at_least = F.col("op") == ">="
    out = f.join(metrics, "metric", "left").withColumn("meets_floor", F.coalesce(
        F.when(at_least, F.col("value") >= F.col("floor")).otherwise(F.col("value") <= F.col("floor")), F.lit(False)))
    if baseline is not None:
        worse = F.when(at_least, F.col("baseline") - F.col("value")).otherwise(F.col("value") - F.col("baseline"))
        out = out.join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "left") \
            .withColumn("regressed", F.coalesce(F.round(worse, 9) > tolerance, F.lit(False)))
    return out


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two binary rater columns from the confusion counts (one pass)."""
    x = pairs.agg(F.count("*").alias("n"),
                  F.count_if(F.col(a) == F.col(b)).alias("agree"),
                  F.count_if(F.col(a) == 1).alias("a1"), F.count_if(F.col(b) == 1).alias("b1"))
    po = F.col("agree") / F.col("n")
    pe = (F.col("a1") * F.col("b1") + (F.col("n") - F.col("a1")) * (F.col("n") - F.col("b1"))) / (F.col("n") * F.col("n"))
    return x.select("n", F.round(po, 9).alias("observed_agreement"), F.round(pe, 9).alias("expected_agreement"),
                    F.round(F.try_divide(po - pe, 1 - pe), 9).alias("kappa"))

