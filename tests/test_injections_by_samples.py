"""The injected warehouse without a scan for its files and without a shuffle for its samples."""

import pytest
from pyspark.sql import functions as F

from wardlens.operators import quality as Q


def test_state_of_the_tables_needs_no_row(spark, tmp_path):
    from wardlens.plans.q_quality import _snapshot
    for t in ("orders", "lineitem", "customer", "supplier", "nation", "region", "part"):
        (tmp_path / f"{t}.parquet").write_text("no rows to read")
    before = _snapshot(spark, str(tmp_path))
    assert len(before) == 7 and _snapshot(spark, str(tmp_path)) == before
    (tmp_path / "orders.parquet").write_text("other rows")
    assert _snapshot(spark, str(tmp_path)) != before


@pytest.mark.parametrize("tried", [1, 20])
@pytest.mark.parametrize("n", [0, 5, 40, 500])
def test_sample_of_ids_that_occur_once(spark, monkeypatch, tried, n):
    monkeypatch.setattr(Q, "TRIED", tried)
    rows = [(str(i), "A" if i % 3 else "B") for i in range(200) for _ in range(1 + i % 2)] + [("x", "A"), ("x", None), ("y", None)]
    enc = spark.createDataFrame(rows, "Id string, ENCOUNTERCLASS string").repartition(3)
    cond = F.col("ENCOUNTERCLASS") == "A"
    want = Q._sample(Q.not_duplicated(enc).where(cond), 7, n).collect()
    assert {r.Id for r in Q.sample_once(enc, cond, 7, n).collect()} == {r.Id for r in want}


def test_vectors_and_steps_without_shuffles(spark):
    from wardlens.operators import retrieval as RV
    docs = spark.createDataFrame([(1, "a b b c"), (2, None), (3, " ")], "doc_id long, text string")
    v = RV.text_vectors(docs)
    assert "Exchange" not in v._jdf.queryExecution().executedPlan().toString()
    assert [r.item_id for r in v.collect()] == [1]
