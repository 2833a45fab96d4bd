"""Plan properties the scale design relies on, read from ``explain()``."""

import contextlib
import io

import pytest

from table_fixtures import SF_SMOKE


def plan_text(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def qs():
    from __spark_entry__ import queries
    return queries()


def test_class_filter_reaches_the_orders_scan_and_copies_combine_map_side(spark, qs):
    p = plan_text(qs["admission_count"](spark, SF_SMOKE))
    assert "EqualTo(o_orderpriority,1-URGENT)" in p
    assert "GreaterThanOrEqual(o_orderdate" in p            # period pushed to the scan
    assert "partial_min" in p                                # copies combined before the shuffle


@pytest.mark.parametrize("key", ["readmission_30day", "transfer_pairs", "join_range_followup", "payer_mix_encounters",
                                 "call_cost", "dense_topk", "phrase_screen", "drift_verdict", "table_profile"])
def test_no_nested_loops_or_cartesian_products(spark, qs, key):
    p = plan_text(qs[key](spark, SF_SMOKE), "simple")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p                        # no row-at-a-time Python UDF


def test_range_join_is_keyed_by_patient_and_day_bucket(spark, qs):
    p = plan_text(qs["join_range_followup"](spark, SF_SMOKE), "simple")
    assert "SortMergeJoin" in p or "BroadcastHashJoin" in p or "ShuffledHashJoin" in p
    assert "FLOOR" in p.upper()


def test_topk_limits_before_the_shuffle(spark, qs):
    p = plan_text(qs["win_topk_per_query"](spark, SF_SMOKE), "simple")
    assert "WindowGroupLimit" in p
