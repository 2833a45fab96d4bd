"""Argument hashes, open attributes, plans as graphs, versions at the time of a run, and
the gate over all of its metrics."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from table_fixtures import SF_CHECK, ts
from wardlens.functions.exprs import args_hash, canonical_json, recipe_of
from wardlens.operators import identity as I
from wardlens.operators import runs as R
from wardlens.operators.relational import as_of
from wardlens.sources import files as Fs


def shuffled(rng, x):
    """JSON text of ``x`` with keys in any order and blanks anywhere."""
    gap = lambda: rng.choice(["", " ", "\n\t"])
    if isinstance(x, dict):
        items = [f"{gap()}{json.dumps(k, ensure_ascii=rng.random() < .5)}{gap()}:{shuffled(rng, v)}" for k, v in x.items()]
        rng.shuffle(items)
        return "{" + ",".join(items) + gap() + "}"
    if isinstance(x, list):
        return "[" + ",".join(shuffled(rng, v) for v in x) + "]"
    return gap() + json.dumps(x, ensure_ascii=rng.random() < .5) + gap()


def some_json(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 5:
        return rng.choice([None, True, False, rng.randrange(-9, 10**12), 'a "quoted" \\ / text\n', "é日😀 ", "", 0.25])
    if kind == 5:
        return [some_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["b", "a", "A", "z z", "ä", "10", "9", ""]) + str(i): some_json(rng, depth + 1) for i in range(rng.randrange(5))}


def test_args_hash_does_not_see_the_order_of_keys(spark):
    rng = random.Random(1)
    values = [some_json(rng) for _ in range(150)] + [{"a": 1, "b": {"d": [1, {"y": 2, "x": 1}], "c": None}}]
    rows = [(i, shuffled(rng, v)) for i, v in enumerate(values) for _ in range(3)]
    got = spark.createDataFrame(rows, "i int, j string").select("i", args_hash("j").alias("h"), canonical_json("j").alias("c")).collect()
    for r in got:
        want = json.dumps(values[r.i], sort_keys=True, separators=(",", ":"))
        assert r.c == want and r.h == hashlib.sha256(want.encode()).hexdigest()[:16]


def test_args_hash_of_what_is_no_json(spark):
    df = spark.createDataFrame([("run {x}",), (None,), ('{"a":1,"a":2}',)], "j string").select(args_hash("j").alias("h"))
    assert [r.h for r in df.collect()] == [hashlib.sha256(b"run {x}").hexdigest()[:16], None, hashlib.sha256(b'{"a":1,"a":2}').hexdigest()[:16]]


def test_equal_arguments_in_another_order_are_a_repeat(spark):
    rows = [("r", "a", 1, '{"q":"x","k":{"b":2,"a":1}}'), ("r", "b", 2, '{"k": {"a":1, "b":2}, "q":"x"}'), ("r", "c", 3, '{"q":"y"}')]
    steps = spark.createDataFrame(rows, "run_id string, span_id string, start_ns long, j string") \
        .select("run_id", "span_id", "start_ns", F.lit("search").alias("tool"), args_hash("j").alias("args_hash"))
    assert [r.span_id for r in R.repeated_calls(steps).collect()] == ["b"]


def test_recipe_of(spark):
    df = spark.createDataFrame([("seed-7+content.ab12",), ("plain",), ("a+content.b+content.c",), (None,)], "v string")
    assert [r.r for r in df.select(recipe_of("v").alias("r")).collect()] == ["seed-7", "plain", "a+content.b", None]


# --- attributes ---------------------------------------------------------------------------

def logged(tmp_path, rows, name="spans.jsonl"):
    run = tmp_path / "runs" / "demo"
    run.mkdir(parents=True, exist_ok=True)
    (run / name).write_text("\n\n".join(json.dumps(x) for x in rows) + "\n")
    return str(tmp_path / "runs")


def test_unknown_attributes_survive_and_retrievals_are_checked(spark, tmp_path):
    full = {k: "v" for k in R.RETRIEVAL_ATTRIBUTES} | {"retrieval.k": 3, "retrieval.scores": [0.5, 0.25]}
    rows = [{"name": "tool.call", "span_id": "ok", "attributes": full | {"team.own": "kept", "cost.usd": 0.5}},
            {"name": "tool.call", "span_id": "bad", "run_id": "named", "attributes": {k: v for k, v in full.items() if k != "retrieval.backend"}
             | {"retrieval.k": None}},
            {"name": "node", "span_id": "other", "attributes": {"agent.role": "planner", "retry.count": "no number"}}]
    spans = Fs.span_source(spark, logged(tmp_path, rows))
    by = {r.span_id: r for r in spans.collect()}
    assert by["ok"].all_attributes["team.own"] == "kept" and by["ok"].attributes["cost.usd"] == 0.5
    assert by["ok"].all_attributes["retrieval.scores"] == "[0.5, 0.25]" and by["other"].attributes["retry.count"] is None
    assert by["bad"].run_id == "named" and by["ok"].run_id == "demo"
    missing = {(r.run_id, r.span_id, r.missing_attribute) for r in R.retrieval_attributes(spans).collect()}
    assert missing == {("named", "bad", "retrieval.backend"), ("named", "bad", "retrieval.k")}
    left = {r.missing_attribute for r in R.required_attributes(spans, ("team.own", "agent.role", "no.such")).where("run_id = 'demo'").collect()}
    assert left == {"no.such"}


# --- plans --------------------------------------------------------------------------------

def test_plans_are_graphs(spark):
    plans = {"diamond": ("abcd", ["ab", "ac", "bd", "cd"]), "cycle": ("abcde", ["ab", "bc", "cb", "cd", "ae"]),
             "self": ("ab", ["aa"]), "chain": ("abcdefgh", ["ab", "bc", "cd", "de", "ef", "fg", "gh", "ah"]), "alone": ("a", [])}
    st = [(r, x) for r, (ids, _) in plans.items() for x in ids] + [("twice", "a"), ("twice", "a"), ("open", "a")]
    ed = [(r, e[0], e[1]) for r, (_, es) in plans.items() for e in es] + [("open", "a", "x"), ("open", None, "a"), ("diamond", "a", "b")]
    sub = spark.createDataFrame(st, "run_id string, subtask_id string")
    edges = spark.createDataFrame(ed, "run_id string, src string, dst string")
    whole = edges.where("dst <> 'x' and src is not null")
    got = {(r.run_id, r.subtask_id): r.layer for r in R.plan_layers(sub, whole).collect()}
    assert [got["diamond", x] for x in "abcd"] == [0, 1, 1, 2]
    assert [got["cycle", x] for x in "abcde"] == [0, None, None, None, 1]
    assert [got["self", x] for x in "ab"] == [None, 0]
    assert [got["chain", x] for x in "abcdefgh"] == list(range(8))
    assert got["alone", "a"] == 0 and got["twice", "a"] == 0
    deps = spark.createDataFrame([("alone", "a", "zz"), ("chain", "h", "a")], "run_id string, subtask_id string, depends_on string")
    r = {x.run_id: x for x in R.plan_integrity(sub, deps, edges).collect()}
    assert {k for k, x in r.items() if x.plan_ok} == {"diamond", "chain"}
    assert r["cycle"].n_cyclic == 3 and r["self"].n_cyclic == 1 and r["open"].n_unresolved_edges == 2
    assert r["alone"].n_unresolved == 1 and r["twice"].n_duplicate_ids == 1


def test_layers_match_removal_by_hand(spark):
    rng = random.Random(5)
    st, ed, want = [], [], {}
    for run in range(60):
        n = rng.randint(1, 12)
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(14))}
        st += [(run, i) for i in range(n)]
        ed += [(run, a, b) for a, b in edges]
        left, layer = set(range(n)), 0
        while True:
            ready = {x for x in left if not any(b == x and a in left for a, b in edges)}
            if not ready:
                break
            want |= {(run, x): layer for x in ready}
            left, layer = left - ready, layer + 1
        want |= {(run, x): None for x in left}
    got = R.plan_layers(spark.createDataFrame(st, "run_id int, subtask_id int"), spark.createDataFrame(ed, "run_id int, src int, dst int"))
    assert {(r.run_id, r.subtask_id): r.layer for r in got.collect()} == want


# --- versions -----------------------------------------------------------------------------

def test_as_of_takes_the_newest_entry_before(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 7, *range(40)])) for i in range(2000)]             # a hot time and none
    entries = [(rng.randrange(40), rng.choice([None, f"a{i}"]), rng.choice([None, i])) for i in range(25)] + [(None, "never", 1), (12, "x", 3), (12, "y", 2)]
    got = as_of(spark.createDataFrame(rows, "id int, t int").repartition(5), "t",
                spark.createDataFrame(entries, "since int, a string, b int"), "since", ["a", "b"]).collect()

    def held(t, k):
        known = [(e[0], e[k]) for e in entries if t is not None and e[0] is not None and e[0] <= t and e[k] is not None]
        return max(known)[1] if known else None

    assert len(got) == len(rows)
    for r in got:
        assert (r.a, r.b) == (held(r.t, 1), held(r.t, 2))


def test_all_verdicts_by_the_versions_at_the_start(spark):
    t = "2024-01-01 0{}:00:00".format
    history = spark.createDataFrame([(a, ts(t(1)), f"{a}-1") for a in I.AXES] + [
        ("warehouse", ts(t(2)), "warehouse-2"), ("prompts", ts(t(3)), "prompts-2"), ("corpus", ts(t(4)), "corpus-2"),
        ("sandbox", ts(t(5)), "sandbox-2")], "axis string, since timestamp_ntz, version string")
    runs = spark.createDataFrame([(h, ts(t(h) if h else "2023-12-31 00:00:00")) for h in range(7)], "run_id int, start_ts timestamp_ntz")
    verdicts = I.drift_verdict(I.recorded_versions(runs, "start_ts", history), I.current_versions(history))
    got = {r.run_id: r.stale_axis for r in verdicts.collect()}
    assert got == {0: "none_recorded", 1: "warehouse", 2: "prompts", 3: "corpus", 4: "sandbox", 5: "current", 6: "current"}
    reasons = {r.run_id: r.stale_reason for r in I.staleness(verdicts).collect()}
    assert reasons[0] == "no version was recorded" and reasons[5] is None and "corpus" in reasons[3]


def test_every_verdict_occurs_in_the_queries(spark):
    from __spark_entry__ import queries
    q = queries()
    assert {r.stale_axis for r in q["drift_verdict"](spark, SF_CHECK).collect()} == {"none_recorded", *I.AXES, "current"}
    assert {r.verdict for r in q["gate_verdict"](spark, SF_CHECK).collect()} == {"PASS", "STALE", "FAIL"}


def test_a_null_text_is_part_of_the_corpus(spark):
    version = lambda *rows: I.corpus_version(spark.createDataFrame(rows, "doc_id long, text string")).first().corpus_version
    found = [version((1, "a"), (2, "b")), version((1, "a"), (2, None)), version((1, "a"), (3, None)), version((1, "a")), version((1, "a"), (None, "b")),
             version((1, "a"), (2, "-"))]
    assert len(set(found)) == len(found)


# --- the gate -----------------------------------------------------------------------------

def test_gate_has_a_row_for_every_floor(spark):
    m = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    now, before = m([("task_success", 0.9), ("efficiency", 1.4), ("loop_rate", 0.1)]), m([("task_success", 0.95), ("efficiency", 1.2), ("loop_rate", 0.09)])
    got = {r.metric: r for r in R.regression_gate(now, before, 0.02).collect()}
    assert set(got) == {"task_success", "tool_accuracy", "efficiency", "loop_rate", "recovery_rate"}
    assert [got[k].meets_floor for k in ("task_success", "tool_accuracy", "efficiency", "loop_rate")] == [True, False, True, False]
    assert [got[k].regressed for k in ("task_success", "tool_accuracy", "efficiency", "loop_rate")] == [True, False, True, False]


@pytest.mark.parametrize("left_out", range(5))
def test_gate_metrics_are_all_used(spark, left_out):
    name = [m for m, _, _ in R.TARGET_FLOORS][left_out]
    rows = [(m, 1.0 if op == ">=" else 0.0) for m, op, _ in R.TARGET_FLOORS if m != name]
    got = {r.metric: r.meets_floor for r in R.regression_gate(spark.createDataFrame(rows, "metric string, value double")).collect()}
    assert got == {m: m != name for m, _, _ in R.TARGET_FLOORS}
