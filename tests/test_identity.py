"""Digest properties: order- and partition-free, duplicate- and cell-sensitive."""

from pyspark.sql import functions as F

from wardlens.functions.exprs import md5_mod
from wardlens.operators import identity as I


def digest(df):
    return I.table_digest(df, "t").collect()[0]["digest"]


def test_md5_number_little_endian(spark):
    r = spark.createDataFrame([("abc",)], "s string").select(md5_mod("s").alias("m")).collect()[0]["m"]
    assert r == 228655509


def test_digest_properties(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") * 1.5).alias("x"), F.col("id").cast("string").alias("s"))
    d0 = digest(df)
    assert digest(df.repartition(7).orderBy(F.rand(1))) == d0
    assert digest(df.unionByName(df.limit(1))) != d0                       # a duplicate row moves it
    changed = df.withColumn("s", F.when(F.col("id") == 5, "x").otherwise(F.col("s")))
    assert digest(changed) != d0                                            # one changed cell moves it
    nulled = df.withColumn("s", F.when(F.col("id") == 5, None).otherwise(F.col("s")))
    assert digest(nulled) != digest(df.withColumn("s", F.when(F.col("id") == 5, "-").otherwise(F.col("s"))))


def test_fingerprint_and_corpus_version(spark):
    t = {"a": spark.range(10).toDF("v"), "b": spark.range(5).toDF("v")}
    fp = I.warehouse_fingerprint(I.table_digests(t), "r").collect()[0]
    assert len(fp["fingerprint"]) == 12 and fp["version"] == "r+content." + fp["fingerprint"]
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    v1 = I.corpus_version(docs).collect()[0]["corpus_version"]
    v2 = I.corpus_version(docs.withColumn("doc_id", F.col("doc_id") + 100)).collect()[0]["corpus_version"]
    assert len(v1) == 16 and v1 != v2


def test_drift_verdict_order(spark):
    runs = spark.createDataFrame([("r1", None, None, None, None), ("r2", "w0", "p", "c", "s"),
                                  ("r3", "w", "p0", "c0", "s"), ("r4", "w", "p", "c", "s")],
                                 "run_id string, warehouse string, prompts string, corpus string, sandbox string")
    cur = spark.createDataFrame([("w", "p", "c", "s")], "warehouse string, prompts string, corpus string, sandbox string")
    v = {r["run_id"]: r["stale_axis"] for r in I.drift_verdict(runs, cur).collect()}
    assert v == {"r1": "none_recorded", "r2": "warehouse", "r3": "prompts", "r4": "current"}


def test_digests_of_doubles_lose_nothing(spark):
    from wardlens.operators.identity import table_digest
    values = [1e-12, 2e-12, float("nan"), float("inf"), float("-inf"), 1e30, 5e-324, 0.1, 0.30000000000000004, 0.3, 1.0, -1.0, 2.0 ** 52 + 1]
    digests = {table_digest(spark.createDataFrame([(v,)], "x double"), "t").first()["digest"] for v in values}
    assert len(digests) == len(values)
    zero = [table_digest(spark.createDataFrame([(v,)], "x double"), "t").first()["digest"] for v in (0.0, -0.0)]
    assert zero[0] == zero[1]


def test_corpus_version_takes_any_id(spark):
    import pytest

    from wardlens.operators.identity import corpus_version
    docs = spark.createDataFrame([(f"note-{i}", f"text {i}") for i in range(9000)], "doc_id string, text string")
    first = corpus_version(docs).first()
    assert first["n_documents"] == 9000 and corpus_version(docs.repartition(3)).first() == first
    renamed = docs.replace("note-7", "note-x", ["doc_id"])
    assert corpus_version(renamed).first()["corpus_version"] != first["corpus_version"]
    with pytest.raises(ValueError):
        corpus_version(docs.limit(0))


def test_a_cluster_without_shared_folder_is_refused():
    import pytest

    from wardlens.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_only_new_files_are_read(spark, tmp_path, monkeypatch):
    """Appended, changed, removed and repeated files: the kept digests give what a full run gives."""
    import shutil
    from pyspark.sql import functions as F
    from wardlens.operators import identity as I
    path, state = str(tmp_path / "t able+é"), str(tmp_path / "state")
    df = spark.range(1000).select("id", (F.col("id") * 0.5).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))

    def check(n_read):
        got = I.stored_digest(spark, path, "t", state).first()
        want = I.table_digest(spark.read.parquet(path), "t").first()
        assert (got.row_count, got.digest, got.files_read) == (want.row_count, want.digest, n_read)

    df.where("id < 600").repartition(4).write.parquet(path)
    check(4)
    check(0)
    df.where("id >= 600").repartition(2).write.mode("append").parquet(path)
    check(2)
    one = sorted(p for p in (tmp_path / "t able+é").glob("*.parquet"))
    shutil.copy(one[0], one[0].with_name("copy.parquet"))             # equal rows count again
    check(1)
    one[1].unlink()
    check(0)
    df.where("id = 7").coalesce(1).write.parquet(str(tmp_path / "other"))
    shutil.copy(next((tmp_path / "other").glob("*.parquet")), one[2])   # the same name, other content
    (tmp_path / "t able+é" / f".{one[2].name}.crc").unlink(missing_ok=True)
    check(1)
