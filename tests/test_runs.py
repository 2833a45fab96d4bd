"""Hand-made span cases of the trajectory rules."""

from pyspark.sql import functions as F

from wardlens.operators import runs as R
from wardlens.sources.files import SPAN_SCHEMA


def spans(spark, rows):
    data = []
    for (sid, parent, name, start, tool, args, cost, passed, bundle) in rows:
        attrs = {"tool.name": tool, "tool.args_hash": args, "cost.usd": cost, "validation.passed": passed,
                 "context.bundle_tokens": bundle}
        data.append((name, sid, "t", parent, start, start + 10, 1.0, "OK", attrs))
    df = spark.createDataFrame(data, SPAN_SCHEMA)
    return df.withColumn("run_id", F.lit("run1"))


def test_summary_rules(spark):
    rows = [("root", None, "run", 0, None, None, 0.03, None, None),
            # written in end order, started in another order
            ("s3", "root", "tool.call", 300, "run_sql", "h1", 0.01, True, 640),
            ("s1", "root", "node", 100, None, None, 0.01, None, 120),
            ("s2", "root", "tool.call", 200, "run_sql", "h1", 0.01, False, None),
            ("s4", "root", "tool.call", 400, "search", "h2", 0.0, None, 0),
            ("s5", "root", "transport", 500, None, None, 0.0, None, None)]
    o = R.trajectory_order(R.span_steps(spans(spark, rows)))
    order = [r["span_id"] for r in o.orderBy("step_no").collect()]
    assert order == ["root", "s1", "s2", "s3", "s4", "s5"]
    s = R.run_summary(R.span_steps(spans(spark, rows))).collect()[0]
    assert s["steps"] == 4 and s["tool_calls"] == 3 and s["validation_failures"] == 1
    assert s["repeated_calls"] == 1 and s["max_bundle"] == 640
    assert abs(s["cost_usd"] - 0.03) < 1e-12                     # root total not counted twice
    depth = {r["span_id"]: r["depth"] for r in R.span_tree(R.span_steps(spans(spark, rows))).collect()}
    assert depth["root"] == 0 and depth["s1"] == 1
    calls = [r["tool"] for r in R.tool_calls(R.span_steps(spans(spark, rows))).orderBy("call_no").collect()]
    assert calls == ["run_sql", "run_sql", "search"]


def test_any_step_with_a_tool_counts(spark):
    rows = [("n1", None, "node", 1, "search", "h", 0.02, None, None), ("n2", None, "node", 2, "search", "h", 0.0, None, None),
            ("n3", None, "tool.call", 3, "search", None, 0.0, None, None), ("r", None, "run", 0, None, None, 0.02, None, None)]
    steps = R.span_steps(spans(spark, rows))
    s = R.run_summary(steps).collect()[0]
    assert (s["tool_calls"], s["repeated_calls"], s["cost_usd"]) == (3, 1, 0.02)     # all parents missing
    assert [r["span_id"] for r in R.repeated_calls(steps).collect()] == ["n2"]


def test_deep_chains_and_cycles(spark):
    import pytest
    chain = [(f"s{i}", f"s{i - 1}" if i else None, "node", i, None, None, 0.0, None, None) for i in range(31)]
    depth = {r["span_id"]: r["depth"] for r in R.span_tree(R.span_steps(spans(spark, chain))).collect()}
    assert depth == {f"s{i}": i for i in range(31)}
    loop = [("a", "b", "node", 0, None, None, 0.0, None, None), ("b", "a", "node", 1, None, None, 0.0, None, None)]
    with pytest.raises(ValueError):
        R.span_tree(R.span_steps(spans(spark, loop)))


def test_totals_take_one_shuffle(spark):
    rows = [("a", None, "node", 1, "t", "h", 0.1, True, 3)]
    plan = R.run_totals(R.span_steps(spans(spark, rows)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_task_success_rules(spark):
    answers = spark.createDataFrame([("a", "t1", 133.0), ("b", "t1", 145.0), ("c", "t1", None), ("d", "t2", 5.0)],
                                    "run_id string, task_id string, produced double")
    tasks = spark.createDataFrame([("t1", 133.0, 0.0, "verified"), ("t2", 5.0, 0.0, "draft")],
                                  "task_id string, expected double, tolerance double, status string")
    r = {x["run_id"]: x for x in R.task_success(answers, tasks).collect()}
    assert r["a"]["passed"] and not r["b"]["passed"] and not r["c"]["passed"]
    assert r["d"]["score"] == 1.0 and not r["d"]["passed"]


def test_cohen_kappa_perfect_and_chance(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (1, 1), (0, 0)], "a int, b int")
    assert R.cohen_kappa(df, "a", "b").collect()[0]["kappa"] == 1.0


def test_loop_rate_across_blocks_of_steps(spark):
    def run(name, *calls):
        return [(name, "tool.call" if c != "-" else "node", c if c != "?" else None, "h", i) for i, c in enumerate(calls, 1)]

    rows = [*run("at width", *"a----a"), *run("past width", *"a-----a"), *run("inside", *"-aa"), *run("null", *"-----?-?"),
            *run("other", *"abcdefghijk"), *run("far", *"abcdefabcdef"), *run("third", *"a------a----a")]
    ordered = spark.createDataFrame(rows, "run_id string, name string, tool string, args_hash string, step_no int")
    df = R.loop_rate(ordered, 5)
    got = df.first()
    assert (got.n_runs, got.n_looped) == (7, 4)           # at width, inside, null, third
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()      # no row meets its earlier steps one by one


def test_summary_goes_through_the_steps_once(spark):
    rows = [("a", "tool.call", t, h, p, b, c) for t, h, p, b, c in
            [("x", "1", True, 5, 0.25), ("x", "1", False, 7, 0.5), ("x", "2", None, 0, 0.25), ("y", "1", None, None, 0.5), (None, "1", None, None, 0.125),
             ("z", None, None, 3, 0.125), ("z", None, None, 3, 0.125)]] + [("a", "run", None, None, None, None, 9.0), ("b", "run", None, None, None, None, 0.0)]
    steps = spark.createDataFrame(rows, "run_id string, name string, tool string, args_hash string, passed boolean, bundle_tokens long, cost_usd double")
    df = R.run_summary(steps)
    got = {r.run_id: (r.steps, r.tool_calls, r.validation_failures, r.max_bundle, r.cost_usd, r.repeated_calls) for r in df.collect()}
    assert got == {"a": (7, 6, 1, 7, 1.875, 1), "b": (0, 0, 0, None, 0.0, 0)}
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_bound_attributes_are_those_of_the_map(spark):
    from wardlens.plans import bindings as B
    from wardlens.sources.files import typed_attributes
    spans = B.spans_from_events(spark, "/root/testdata/sf0.001")
    both = spans.select("attributes", typed_attributes("all_attributes").alias("of_map"))
    assert both.schema["attributes"].dataType == both.schema["of_map"].dataType
    assert both.where(~F.col("attributes").eqNullSafe(F.col("of_map"))).count() == 0
    few = spans.select("run_id", "attributes.`agent.role`")._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" not in few and "sha2" not in few         # nothing else is computed
