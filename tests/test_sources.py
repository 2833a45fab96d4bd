"""Typed CSV ingest: good, reordered header, wrong type, BOM and case."""

import pytest

from wardlens.sources import files as Fs
from wardlens.sources.tables import DRIVER_TABLES

SCHEMA = DRIVER_TABLES["region"]


def write(tmp_path, name, text):
    d = tmp_path / name
    d.mkdir()
    (d / "part.csv").write_text(text, encoding="utf-8")
    return str(d)


def test_good_file_loads_typed(spark, tmp_path):
    p = write(tmp_path, "good", "r_regionkey,r_name\n1,AFRICA\n2,\n")
    rows = Fs.typed_csv_ingest(spark, p, SCHEMA).orderBy("r_regionkey").collect()
    assert rows[0]["r_regionkey"] == 1 and rows[1]["r_name"] is None


def test_reordered_header_fails(spark, tmp_path):
    p = write(tmp_path, "reordered", "r_name,r_regionkey\nAFRICA,1\n")
    with pytest.raises(Exception):
        Fs.typed_csv_ingest(spark, p, SCHEMA).collect()


def test_wrong_type_fails(spark, tmp_path):
    p = write(tmp_path, "badtype", "r_regionkey,r_name\nx,AFRICA\n")
    with pytest.raises(Exception):
        Fs.typed_csv_ingest(spark, p, SCHEMA).collect()


def test_bom_and_case_accepted(spark, tmp_path):
    p = write(tmp_path, "bom", "﻿R_REGIONKEY,R_Name\n3,ASIA\n")
    assert Fs.typed_csv_ingest(spark, p, SCHEMA).collect()[0]["r_regionkey"] == 3
    h = Fs.header_conformity(spark, p, ["r_regionkey", "r_name"], "region").collect()[0]
    assert h["header_ok"]


def test_result_sink_caps_and_describes(spark, tmp_path):
    df = spark.range(20000).toDF("id")
    d = Fs.result_sink(df, str(tmp_path / "res"), 50000).collect()[0]
    assert d["row_count"] == 10000 and d["schema"] == "id:bigint"


def test_corpus_source_reads_whole_files(spark, tmp_path):
    c = tmp_path / "corpus"
    (c / "sub").mkdir(parents=True)
    (c / "a.md").write_text("# A\nsee [[b]]\n")
    (c / "sub" / "b.txt").write_text("B text")
    (c / "skip.json").write_text("{}")
    rows = {r["doc_id"]: r["text"] for r in Fs.corpus_source(spark, str(c)).collect()}
    assert rows == {"a": "# A\nsee [[b]]\n", "b": "B text"}
