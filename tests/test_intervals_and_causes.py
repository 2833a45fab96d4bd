"""Coverage as unions of intervals, common diagnosis codes, exclusions by table, text
vectors and dense retrieval in tiles, BM25 by either way."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from table_fixtures import ts
from wardlens.operators import metrics as M
from wardlens.operators import relational as RL
from wardlens.operators import retrieval as RV

P, E = "2023-01-01", "2024-01-01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def months(start, stop):
    y, m, out = start.year, start.month, set()
    while (y, m) <= (stop.year, stop.month):
        out.add((y, m))
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return out


def test_member_months_are_the_months_of_the_union(spark):
    rng, rows, want = random.Random(1), [], {}
    day = lambda n: dt.datetime(2022, 10, 1) + dt.timedelta(days=n, hours=rng.randrange(24))
    for i in range(600):
        patient, payer = (0, "a") if i % 3 == 0 else (rng.randrange(12), rng.choice("ab"))     # one hot group
        a = day(rng.randrange(500))
        b = None if rng.random() < .1 else a + dt.timedelta(days=rng.choice([0, 1, 20, 45, 200]))
        rows.append((patient, payer, a, b))
        lo, hi = max(a.date(), dt.date(2023, 1, 1)), min((b or ts(E)).date(), dt.date(2024, 1, 1)) - dt.timedelta(days=1)
        if a < ts(E) and (b or ts(E)) > ts(P):
            first = lo.replace(day=1)
            if hi + dt.timedelta(days=1) > max(first, dt.date(2023, 1, 1)):
                want.setdefault((patient, payer), set()).update(months(first, hi))
    cov = spark.createDataFrame(rows, "patient int, payer string, from_ts timestamp_ntz, to_ts timestamp_ntz")
    got = M.payer_mix_member_months(cov, P, E)
    assert {r.payer: (r.member_months, r.n_members) for r in got.collect()} == {
        p: (sum(len(m) for (_, q), m in want.items() if q == p), sum(1 for (_, q), m in want.items() if q == p and m)) for p in "ab"}
    assert "Generate" not in plan(got)                               # no row for a month


def test_prior_maximum_crosses_partitions(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "x", None]), rng.randrange(10_000), rng.choice([None, rng.randrange(100)])) for i in range(3000)]
    got = RL.prior_max_within(spark.createDataFrame(rows, "id int, g string, o int, v int"), ["g"], ["o", "id"], "v", "m").collect()
    want = {}
    for g in {r[1] for r in rows}:
        top = None
        for i, _, _, v in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            want[i] = top
            top = v if top is None else top if v is None else max(top, v)
    assert {r.id: r.m for r in got} == want


# --- causes and exclusions ------------------------------------------------------------------

def stays(spark, rows):
    return spark.createDataFrame([(i, ts(a), ts(b) if b else None, p, "org", "IP", c) for i, a, b, p, c in rows],
                                 "id string, start_ts timestamp_ntz, stop_ts timestamp_ntz, patient string, organization string, class string, cause string")


def test_a_common_code_makes_the_same_cause(spark):
    s = stays(spark, [("a1", "2023-02-01", "2023-02-05", "a", "x"), ("a2", "2023-02-20", "2023-02-21", "a", "y"),
                      ("b1", "2023-02-01", "2023-02-05", "b", "x"), ("b2", "2023-02-20", "2023-02-21", "b", "x"),
                      ("c1", "2023-02-01", "2023-02-05", "c", "x"), ("c2", "2023-02-20", "2023-02-21", "c", "x"),
                      ("d1", "2023-02-01", "2023-02-05", "d", "x")])
    codes = spark.createDataFrame([("a1", "I50"), ("a1", "J44"), ("a1", "E11"), ("a2", "E11"), ("a2", "J44"), ("b1", "I50"), ("b2", "J44"),
                                   ("c1", None), ("c2", None), ("d1", "I50")], "id string, code string")
    flags = {r.id: r.readmitted for r in M.readmission_flags(s, "IP", P, E, same_cause=True, codes=codes).collect()}
    assert {k for k, v in flags.items() if v} == {"a1"}               # two common codes, one return
    assert M.readmission_rate(s, "IP", P, E, same_cause=True, codes=codes).first().n_readmitted == 1
    by_flag = {r.id for r in M.readmission_flags(s, "IP", P, E, same_cause=True).collect() if r.readmitted}
    assert by_flag == {"b1", "c1"}


def test_exclusions_by_table_and_those_without(spark):
    s = stays(spark, [("a1", "2023-02-01", "2023-02-05", "a", "x"), ("a2", "2023-02-20", "2023-02-21", "a", "y"),
                      ("b1", "2023-02-01", "2023-02-05", "b", "x"), ("b2", "2023-02-20", "2023-02-21", "b", "x"),
                      ("c1", "2023-03-01", "2023-03-05", "c", "x")])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    deaths = spark.createDataFrame([("c", ts("2023-03-04")), ("c", ts("2023-04-01"))], "patient string, death_ts timestamp_ntz")
    full = {"deaths": deaths, "against_advice": ids("b1", "b1"), "planned": ids("a2")}
    r = M.exclusion_report(s, "IP", P, E, **full).first()
    assert (r.n_candidates, r.n_death, r.n_against_advice, r.n_eligible, r.unavailable) == (5, 1, 1, 3, "")
    assert M.readmission_rate(s, "IP", P, E, **full).first().n_readmitted == 0
    bare = M.exclusion_report(s, "IP", P, E).first()
    assert bare.n_eligible == 5 and bare.unavailable == "death,against_advice,planned"
    assert M.readmission_rate(s, "IP", P, E).first().n_readmitted == 2
    d = {x.disposition: x.n_stays for x in M.discharge_disposition(s, "IP", P, E, deaths=deaths, against_advice=ids("b1")).collect()}
    assert d == {"death": 1, "against_advice": 1, "home": 3}
    assert {x.disposition: x.n_stays for x in M.discharge_disposition(s, "IP", P, E).collect()} == {"death": None, "against_advice": None, "home": 5}


# --- retrieval --------------------------------------------------------------------------------

def test_tiles_give_the_exact_best(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = np.round(rng.normal(size=(700, 8)), 2)
    vecs[100:140] = vecs[50]                                          # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(9_000, None)]
    df = spark.createDataFrame(rows, "item_id long, vec array<float>")
    q = df.where("item_id % 3 = 0 or item_id = 9000").select(F.col("item_id").alias("query_id"), F.col("vec").alias("query_vec"))
    exact = np.round(vecs.astype(np.float32).astype(np.float64) @ vecs.astype(np.float32).astype(np.float64).T, RV.SCORE_DIGITS)
    for tile in (2_048, 32):
        monkeypatch.setattr(RV, "TILE_ROWS", tile)
        for self_out in (True, False):
            got = {}
            for r in RV.dense_topk(q, df, 7, exclude_self=self_out).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.item_id)
            for i in range(0, 700, 3):
                order = [j for j in np.lexsort((np.arange(700), -exact[i])) if not (self_out and j == i)]
                assert got[i] == order[:7]
            assert len(got) == 234


def test_text_vectors_are_of_unit_length_and_alike_for_like_texts(spark):
    rows = [(1, "red green blue red"), (2, "Blue red, GREEN red!"), (3, "quite other words"), (4, ""), (5, None), (6, "... --")]
    v = {r.item_id: np.array(r.vec) for r in RV.text_vectors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(v) == {1, 2, 3} and all(abs(x @ x - 1) < 1e-12 and len(x) == RV.TEXT_DIMS for x in v.values())
    assert abs(v[1] @ v[2] - 1) < 1e-12 and abs(v[1] @ v[3]) < 0.7


def test_texts_whose_sums_have_no_length_have_no_rows(spark, tmp_path):
    """Texts without a term, and one whose only term's signs cancel, through the registered query."""
    import hashlib
    import duckdb
    import struct
    from __spark_entry__ import oracle_sql, queries

    def cancels(term):
        v = {}
        for w in struct.unpack(">4I", hashlib.md5(term.encode()).digest()):
            v[w % RV.TEXT_DIMS] = v.get(w % RV.TEXT_DIMS, 0) + (1 if w // RV.TEXT_DIMS % 2 == 0 else -1)
        return not any(v.values())

    none = next(f"w{i}" for i in range(10 ** 6) if cancels(f"w{i}"))
    rows = [(1, "a b b c"), (2, ""), (3, "!!! ---"), (4, f"{none} {none}"), (5, None), (6, f"a {none}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.item_id, r.dim): r.x for r in queries()["text_vectors"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {(i, d): x for i, d, x in con.sql(oracle_sql()["text_vectors"]).fetchall()}
    assert {i for i, _ in got} == {1, 6} and got == want


@pytest.mark.parametrize("group", [256, 3])
def test_bm25_by_broadcast_and_by_pruned_rounds_agree(spark, monkeypatch, group):
    rng = random.Random(4)
    words = [f"w{min(int(rng.expovariate(0.08)), 60)}" for _ in range(9000)]
    docs = spark.createDataFrame([(i, " ".join(words[40 * i:40 * i + rng.randint(0, 40)])) for i in range(220)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(6))) for i in range(30)], "item_id long, text string")
    one = sorted(map(tuple, RV.bm25_topk(items, docs, 5).select("query_id", "item_id", "rank", "score").collect()))
    monkeypatch.setattr(RV, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(RV, "GROUP_QUERIES", group)
    two = sorted(map(tuple, RV.bm25_topk(items, docs, 5).select("query_id", "item_id", "rank", "score").collect()))
    assert [r[:3] for r in one] == [r[:3] for r in two] and np.allclose([r[3] for r in one], [r[3] for r in two])
