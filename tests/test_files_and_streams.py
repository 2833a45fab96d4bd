"""Sources of many files, described results, and streams whose state is bounded."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.sources import files as Fs
from wardlens.streaming import feeds

COLUMNS = ["id", "name"]


def test_header_of_every_file(spark, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    long_name = "n" * 200_000
    files = {"a.csv": "id,name\n1,x\n", "b.csv": "name,id\nx,1\n", "sub/c.csv": "﻿ID,Name\r\n2,y\n", "d.csv": "", "e e%20+é.csv": "id,name",
             "f.csv": f"id,{long_name}\n1,x\n", "skip.txt": "id\n"}
    for name, text in files.items():
        (d / name).write_text(text, encoding="utf-8", newline="")
    got = {r.file.split("/in/")[1]: r for r in Fs.header_conformity(spark, str(d), COLUMNS, "t").collect()}
    assert {k for k, r in got.items() if r.header_ok} == {"a.csv", "sub/c.csv", "e e%20+é.csv"}
    assert set(got) == set(files) - {"skip.txt", "d.csv"} and got["f.csv"].actual_header == f"id,{long_name}"


def test_first_lines_by_scan_are_the_same(spark, tmp_path, monkeypatch):
    for k in range(5):
        (tmp_path / f"{k} x+é%20.csv").write_text(f"head{k}\n" + "row\n" * 3000 * k, newline="")
    direct = {r.path: r.line for r in Fs.first_lines(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(Fs, "DIRECT_SCHEMES", ())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert {r.path: r.line for r in Fs.first_lines(spark, str(tmp_path)).collect()} == direct
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(direct.values()) == [f"head{k}" for k in range(5)]


def test_corpus_of_files_and_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}\n\n é" * (i % 3 + 1)) for i in range(50)], "doc_id long, text string")
    path = Fs.write_corpus(docs.where("doc_id < 40"), str(tmp_path / "corpus"))
    Fs.write_corpus(docs.where("doc_id < 10"), path)                  # a task that runs again
    Fs.write_corpus_rows(docs.where("doc_id >= 40"), path)
    got = Fs.corpus_source(spark, path)
    assert sorted((int(r.doc_id), r.text) for r in got.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert len(list((tmp_path / "corpus").iterdir())) <= 2            # no folder per document


def test_absent_or_empty_corpus_is_an_error(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.csv").write_text("a")
    for path in (tmp_path / "empty", tmp_path / "none"):
        with pytest.raises(Exception):
            Fs.corpus_source(spark, str(path))


ODD_CORPUS = {"a b/1 x.txt": b"x", "_hidden/h.txt": b"x", ".hid/g.txt": b"x", "x=1/\u00e9%20+#/\u00fc+%41;&$?.md": b"y", "_x.txt": b"x",
              "_a=b.txt": b"x", "z.TXT": b"x", "e.txt": b"", "bom.txt": b"\xef\xbb\xbfhi\r\n", "bytes.txt": b"a\xff\xfeb", "q'\"^`|~.txt": b"q",
              "r.json": b'{"doc_id":"k","text":"t"}\r{"doc_id":5}\r\n\n[{"doc_id":"l","text":"u"},{"doc_id":"m"}]\n{"doc_id":"bad"\n'
                        b'{"doc_id":"o","text":{"a":1}}\n{"doc_id":"p","text":"\xff"}', "s/[1].jsonl": b'{"doc_id":"v","text":"w"}\n'}


def test_corpus_files_are_listed_and_read_in_tasks(spark, tmp_path, monkeypatch):
    """No name of a file comes to the driver, and the rows are those of Spark's readers."""
    for name, content in ODD_CORPUS.items():
        (tmp_path / "c" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / name).write_bytes(content)
    path = str(tmp_path / "c")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for pattern in ("*", "*.{md,txt}", "?.json"):
        assert rows(Fs.listed_in_tasks(spark, Fs._root(spark, path), pattern)) == rows(Fs.file_list(spark, path, pattern))
    got = Fs.corpus_source(spark, path)
    assert rows(got) == rows(Fs._corpus_by_reader(spark, path)) and len(rows(got)) == 12
    assert not [f for f in got.inputFiles() + Fs.first_lines(spark, path).inputFiles() if "/c/" in f]
    monkeypatch.setattr(Fs, "JSON_BYTES", 10)                         # long files of rows, which Spark splits
    assert rows(Fs.corpus_source(spark, path)) == rows(got)


def test_result_is_described_while_it_is_written(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(3, "c", None), (1, None, 1.5), (None, "z", 2.0), (1, "a", None), (2, "b", 0.5), (9, "i", 0.1)]
    df = spark.createDataFrame(rows, "id int, name string, v double").mapInArrow(count, "id int, name string, v double")
    r = Fs.result_sink(df, str(tmp_path / "r")).first()
    assert [tuple(x) for x in r.head] == [(1, "a", None), (1, None, 1.5), (2, "b", 0.5), (3, "c", None), (9, "i", 0.1)]
    assert r.row_count == 6 and r.schema == "id:int,name:string,v:double"
    assert r.n_bytes == sum(f.stat().st_size for f in (tmp_path / "r").glob("*.parquet"))
    assert seen.value == 6                                            # computed once
    none = Fs.result_sink(df.where("id > 100"), str(tmp_path / "e")).first()
    assert none.row_count == 0 and none["head"] == []


# --- streams ------------------------------------------------------------------------------

FEED = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("v", T.StringType())])


def test_a_batch_costs_what_it_delivers(spark, tmp_path):
    """20 batches of 200 rows, half of them seen before: no batch reads what was written."""
    feed, day = str(tmp_path / "feed"), dt.datetime(2024, 1, 1)
    for k in range(20):
        ids = [*range(100 * k, 100 * k + 100), *range(50 * k, 50 * k + 100)]
        spark.createDataFrame([(i, day, f"v{i}") for i in ids], FEED).coalesce(1).write.mode("append").parquet(feed)
    q = feeds.start_dedupe(spark, feed, FEED, "id", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    progress = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(progress) == 20 and all(p["numInputRows"] == 200 for p in progress)
    assert all(len(p["sources"]) == 1 and p["sources"][0]["numInputRows"] == 200 for p in progress)
    states = [p["stateOperators"][0] for p in progress]
    assert all(s["numRowsUpdated"] <= 200 for s in states) and states[-1]["numRowsTotal"] == 2000
    assert any("rocksdb" in k for k in states[-1]["customMetrics"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != feeds.STATE_CONF["spark.sql.streaming.stateStore.providerClass"]
    # a restart goes on where it stopped
    spark.createDataFrame([(0, day, "v0"), (9_999, dt.datetime(2020, 1, 1), "late")], FEED).coalesce(1).write.mode("append").parquet(feed)
    feeds.start_dedupe(spark, feed, FEED, "id", str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2001 and got.where("id = 9999").first().v == "late"


def test_root_span_closes_a_run(spark, tmp_path):
    def log(batch, rows):
        d = tmp_path / "runs" / f"{batch:02d}"
        d.mkdir(parents=True)
        (d / "spans.json").write_text("\n".join(json.dumps({"name": n, "span_id": f"{batch}-{i}", "run_id": r, "attributes": {"cost.usd": c}})
                                                for i, (r, n, c) in enumerate(rows)))

    log(0, [("a", "node", 0.25), ("b", "tool.call", 0.5), ("c", "node", None)])
    log(1, [("a", "tool.call", 1.0), ("a", "run", 1.25)])
    runs, out, ckpt = str(tmp_path / "runs"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = feeds.start_run_totals(spark, runs, out, ckpt)
    q.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("a", 2, 1.25)]
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 2      # the closed run is forgotten
    log(2, [("b", "run", 0.5), ("a", "node", 0.5), ("a", "run", None), ("d", "run", 3.0)])
    feeds.start_run_totals(spark, runs, out, ckpt).awaitTermination()
    total = spark.read.schema(feeds.TOTALS).parquet(out).groupBy("run_id").agg(F.sum("n_spans").alias("n"), F.sum("cost_usd").alias("c"))
    assert sorted(tuple(r) for r in total.collect()) == [("a", 3, 1.75), ("b", 1, 0.5), ("d", 0, 0.0)]
