"""Approximate nearest neighbours by inner product (operator 10): multiprobe p-stable
hashing.

Vectors are scaled into the unit ball and given one more coordinate that puts them on
the sphere, so the largest inner product is the smallest distance.  Each of ``TABLES``
tables hashes a vector with ``HASHES`` Gaussian projections cut into cells of width
``WIDTH``.  A query visits, in every table, its own bucket and the perturbed buckets of
smallest total squared distance to the crossed cell edges (the estimated success order);
the union of the tables' candidates is ranked by the exact inner product.

A bucket larger than ``BLOCK`` is split by a hash of the id and its probes go to every
block, so no task gathers a hot bucket.  Queries that found fewer than k candidates are
compared with all rows, in blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import make_importable
from .common import BATCH_ROWS, record, store

K = 20
EVERY = 20
TABLES, HASHES, WIDTH, PROBES = 4, 5, 2.0, 40
BLOCK = 4096
SEED = 20_11

ROW = pa.schema([("tbl", pa.int32()), ("key", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("vec", pa.binary())])
ROW_DDL = "tbl int, key long, kind int, id long, vec binary"
FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])
HIT = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part, repeated rows once."""
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .where(f"vec_id is not null and embedding is not null and {finite} and exists(embedding, x -> x != 0)")
            .distinct())


def nearest_few(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids: no query can need another (its own is one
    of them at most, and ties go to the smaller id)."""
    w = Window.partitionBy("embedding").orderBy("vec_id")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).drop("_r")


def _key(cells: np.ndarray, d: int) -> np.ndarray:
    h = np.full(cells.shape[:-1], d, np.uint64)
    for j in range(cells.shape[-1]):
        h = (h ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _tables(d: int):
    rng = np.random.default_rng([SEED, d])
    return [(rng.normal(size=(d + 1, HASHES)), rng.uniform(0, WIDTH, HASHES)) for _ in range(TABLES)]


def perturbations(edge: np.ndarray, probes: int):
    """Cell steps of the ``probes`` best buckets for one query.  ``edge``: for each hash
    the distance to the lower and to the upper edge of its cell, in cells."""
    n = len(edge) // 2
    order = np.argsort(edge, kind="stable")
    cost = edge[order] ** 2
    steps, heap = [np.zeros(n, np.int64)], [(cost[0], (0,))]
    while heap and len(steps) < probes:
        total, picked = heapq.heappop(heap)
        last = picked[-1]
        if last + 1 < 2 * n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*picked[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*picked, last + 1)))
        hashes = order[list(picked)] % n
        if len(set(hashes.tolist())) == len(picked):       # not up and down at once
            step = np.zeros(n, np.int64)
            step[hashes] = np.where(order[list(picked)] < n, -1, 1)
            steps.append(step)
    return np.array(steps)


def _hashed(scale: float, top: float, probes: int | None):
    """Rows of the index (probes None), or the probes of queries."""
    def run(batches):
        for b in batches:
            ids, vecs = b.column("vec_id").to_numpy(), b.column("embedding").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                by_dim.setdefault(len(v), []).append(i)
            for d, at in by_dim.items():
                x = np.array([vecs[i] for i in at]).reshape(len(at), d)
                raw = [r.tobytes() for r in x]
                y = x / scale / top
                if probes is not None:
                    y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
                    y = np.hstack([y, np.zeros((len(at), 1))])
                else:
                    y = np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1, keepdims=True)))])
                for t, (a, shift) in enumerate(_tables(d)):
                    h = (y @ a + shift) / WIDTH
                    cell = np.floor(h).astype(np.int64)
                    if probes is None:
                        yield record(ROW, [t] * len(at), _key(cell, d), [1] * len(at), ids[at], raw)
                        continue
                    frac = h - cell
                    for i, n in enumerate(at):
                        keys = np.unique(_key(cell[i] + perturbations(np.concatenate([frac[i], 1 - frac[i]]), probes), d))
                        yield record(ROW, [t] * len(keys), keys, [0] * len(keys), [ids[n]] * len(keys), [raw[i]] * len(keys))
    return run


def _ranked(k: int):
    """Rows sorted by block, queries first: the k best of each query in this partition."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def score(queries, ids, data):
        if not queries or not ids:
            return
        x, v = np.frombuffer(b"".join(data)).reshape(len(ids), -1), np.array(ids)
        for lo in range(0, len(queries), 512):
            part = queries[lo:lo + 512]
            q = np.frombuffer(b"".join(r for _, r in part)).reshape(len(part), -1)
            s = q @ x.T
            for i, (qid, _) in enumerate(part):
                had_s, had_v = best.get(qid, (np.zeros(0), np.zeros(0, np.int64)))
                slack = 1e-9 * (1 + abs(s[i]).max())
                floor = had_s[-1] if len(had_s) == k else -np.inf
                if len(ids) > 2 * k:
                    floor = max(floor, np.partition(s[i], -k - 1)[-k - 1])   # one may be the query's own
                at = np.flatnonzero(s[i] >= floor - slack)
                at = at[v[at] != qid]
                if len(at):
                    exact = (q[i] * x[at]).sum(axis=1)       # the same sum for equal vectors
                    new_s, new_v = np.concatenate([had_s, exact]), np.concatenate([had_v, v[at]])
                    new_v, first = np.unique(new_v, return_index=True)
                    new_s = new_s[first]
                    top = np.lexsort((new_v, -new_s))[:k]
                    best[qid] = new_s[top], new_v[top]

    def run(batches):
        block, queries, ids, data = None, [], [], []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("tbl", "key", "salt", "kind", "id", "vec")]
            for tbl, key, salt, kind, i, vec in zip(*cols):
                if (tbl, key, salt) != block:
                    score(queries, ids, data)
                    block, queries, ids, data = (tbl, key, salt), [], [], []
                if kind == 0:
                    queries.append((i, vec))
                else:
                    ids.append(i)
                    data.append(vec)
                    if len(ids) == 2 * BLOCK:
                        score(queries, ids, data)
                        ids, data = [], []
        score(queries, ids, data)
        done = list(best.items())
        for lo in range(0, len(done), 4096):
            part = done[lo:lo + 4096]
            yield record(FOUND, [q for q, _ in part], [v.tobytes() for _, (_, v) in part], [s.tobytes() for _, (s, _) in part])
    return run


def _best_of(k: int):
    """Rows sorted by query, one a partition that scored it: the k best of each query."""
    def top(qid, ids, scores):
        v, first = np.unique(np.frombuffer(b"".join(ids), np.int64), return_index=True)
        s = np.frombuffer(b"".join(scores))[first]
        order = np.lexsort((v, -s))[:k]
        return record(HIT, [qid] * len(order), list(range(1, len(order) + 1)), v[order], s[order])

    def run(batches):
        query, ids, scores = None, [], []
        for b in batches:
            for qid, v, s in zip(*(b.column(c).to_pylist() for c in ("query_id", "ids", "scores"))):
                if qid != query and ids:
                    yield top(query, ids, scores)
                    ids, scores = [], []
                query = qid
                ids.append(v)
                scores.append(s)
        if ids:
            yield top(query, ids, scores)
    return run


def _merge(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """index, probes: (tbl, key, salt, kind, id, vec).  The k best of each query."""
    return (index.unionByName(probes).repartition("tbl", "key", "salt")
            .sortWithinPartitions("tbl", "key", "salt", "kind")
            .mapInArrow(_ranked(k), "query_id long, ids binary, scores binary")
            .repartition("query_id").sortWithinPartitions("query_id")
            .mapInArrow(_best_of(k), "query_id long, rank int, vec_id long, score double"))


def _packed(rows: DataFrame, kind: int) -> DataFrame:
    def run(batches):
        for b in batches:
            raw = [np.array(v, float).tobytes() for v in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("tbl"), b.column("key"), b.column("salt"), pa.array([kind] * len(b), pa.int32()), b.column("id"),
                 pa.array(raw, pa.binary())], ["tbl", "key", "salt", "kind", "id", "vec"])
    return rows.select("tbl", "key", "salt", "id", "embedding").mapInArrow(run, "tbl int, key long, salt int, kind int, id long, vec binary")


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose vec_id is divisible by
    ``every`` its k largest inner products among all other rows, ties to the smaller id.

    Vectors that are null, zero or not wholly finite, and rows without vec_id take no
    part; repeated rows count once; vectors of another length are no candidates; further
    columns do no harm; an empty table, or one row, gives an empty result."""
    spark = embeddings.sparkSession
    make_importable(spark)
    spark.conf.set(BATCH_ROWS, "4096")
    rows = valid_vectors(embeddings)
    scale = rows.agg(F.max(F.expr("array_max(transform(embedding, x -> abs(x)))")).alias("m")).first()["m"] or 1.0
    top = rows.agg(F.max(F.expr(f"sqrt(aggregate(embedding, 0d, (s, x) -> s + (x / {scale!r}d) * (x / {scale!r}d)))")).alias("m")).first()["m"] or 1.0
    data = nearest_few(rows, k)
    queries = rows.where(F.col("vec_id") % every == 0)

    index = data.mapInArrow(_hashed(scale, top, None), ROW_DDL)
    sizes = index.groupBy("tbl", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    spread = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("salt")
    cols = ["tbl", "key", "kind", "id", "vec"]
    index = index.join(sizes, ["tbl", "key"]).select(*cols, spread)
    visits = queries.mapInArrow(_hashed(scale, top, probes), ROW_DDL).join(sizes, ["tbl", "key"]) \
        .select(*cols, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    found = store(_merge(index, visits, k), "op10-found")

    # queries with fewer than k: against all rows, in blocks
    dims = data.groupBy(F.size("embedding").cast("long").alias("key")).agg(F.count("*").alias("n")) \
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    got = found.groupBy("query_id").agg(F.count("*").alias("got"))
    as_row = [F.lit(-1).alias("tbl"), F.size("embedding").cast("long").alias("key")]
    vec = F.expr("embedding").alias("embedding")
    short = queries.select(F.col("vec_id").alias("id"), vec, *as_row).join(dims, "key") \
        .join(got.withColumnRenamed("query_id", "id"), "id", "left") \
        .where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1))
    short = store(short.select("tbl", "key", "id", "embedding", "blocks"), "op10-short")
    result = found
    if not short.isEmpty():
        probes_all = short.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        all_rows = data.select(F.col("vec_id").alias("id"), vec, *as_row).join(dims, "key").withColumn("salt", spread)
        full = _merge(_packed(all_rows, 1), _packed(probes_all, 0), k)
        result = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(full)
    return result.select("query_id", "rank", "vec_id", "score")
