"""Exact dedup by composable polynomial fingerprints (operator 3).

Texts are equal when identical without the white space ``[\\x20\\x09-\\x0D]``.  The
fingerprint of a text is its byte polynomial modulo two primes, so the fingerprint of
a whole is the sum of its chunks' fingerprints, each shifted by the length before it:
chunks of a huge document are hashed in parallel and added up in any order.  Rows with
equal fingerprint and length are then compared with the smallest row of their group
chunk by chunk; rows that differ (a collision) go to another round among themselves.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_doc_id, doc_rows, record, small_batches, store, strings_of, text_key

WHITE = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 16                       # bytes of a chunk
PARALLEL_BYTES = 8 << 20              # longer texts are hashed by several tasks
MODULI = ((1 << 31) - 1, 2147483629)  # fixed values: the two largest primes below 2^31
BASES = (1_000_003, 69_621)

PART = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("tkey", pa.int64()), ("n_cp", pa.int64()),
                  ("n_bytes", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sha", pa.string())])
PIECE = pa.schema([*list(PART)[:4], ("start", pa.int64()), ("piece", pa.binary()), ("sha", pa.string())])
BYTES = pa.schema([("id", pa.int64()), ("tkey", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def fingerprint(data: bytes, start: int, moduli=MODULI) -> list[int]:
    """The polynomials of ``data`` as it stands ``start`` bytes into a text."""
    out = []
    for base, p in zip(BASES, moduli):
        powers = _powers(base, p)
        total = 0
        for at in range(0, len(data), CHUNK):
            part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at)
            one = int(np.dot(part.astype(np.int64) + 1, powers[:len(part)])) % p
            total += one * pow(base, start + at, p)
        out.append(total % p)
    return out


_POWERS: dict = {}


def _powers(base: int, p: int) -> np.ndarray:
    if (base, p) not in _POWERS:
        powers = np.ones(CHUNK, np.int64)
        n = 1
        while n < CHUNK:                  # powers[n:2n] = powers[:n] * base^n
            powers[n:2 * n] = powers[:n] * pow(base, n, p) % p
            n *= 2
        _POWERS[base, p] = powers
    return _POWERS[base, p]


def _whole(moduli):
    def run(batches):
        for b in batches:
            rows = [], [], [], []
            for t in strings_of(b.column("text")):
                t = t.translate(None, WHITE)
                for out, v in zip(rows, (len(t), *fingerprint(t, 0, moduli), hashlib.sha256(t).hexdigest())):
                    out.append(v)
            yield record(PART, b.column("row"), b.column("id"), b.column("tkey"),
                         pc.utf8_length(b.column("text")).cast(pa.int64()), *rows)
    return run


def _pieces(batches):
    for b in batches:
        for i, t in enumerate(strings_of(b.column("text"))):
            t = t.translate(None, WHITE)
            sha = hashlib.sha256(t).hexdigest()
            own = [b.column(k)[i].as_py() for k in ("row", "id", "tkey")]
            own.append(pc.utf8_length(b.column("text").slice(i, 1))[0].as_py())
            for at in range(0, max(1, len(t)), PARALLEL_BYTES):
                piece = t[at:at + PARALLEL_BYTES]
                yield record(PIECE, *[[v] for v in own], [at], [piece], [sha])


def _hash_pieces(moduli):
    def run(batches):
        for b in batches:
            parts = [(len(t), *fingerprint(t, s, moduli)) for s, t in zip(b.column("start").to_pylist(), b.column("piece").to_pylist())]
            yield record(PART, *[b.column(k) for k in ("row", "id", "tkey", "n_cp")],
                         *[[p[i] for p in parts] for i in range(3)], b.column("sha"))
    return run


def summaries(rows: DataFrame, moduli=MODULI, parallel_bytes: int = PARALLEL_BYTES) -> DataFrame:
    """One row per input row: length, fingerprint and SHA-256 of its normalised text."""
    rows = rows.withColumn("tkey", text_key()).withColumn("row", F.monotonically_increasing_id())
    size = F.octet_length("text")
    short = rows.where(size <= parallel_bytes).mapInArrow(_whole(moduli), _ddl(PART))
    long = (rows.where(size > parallel_bytes).mapInArrow(_pieces, _ddl(PIECE))
            .repartition("row", "start").mapInArrow(_hash_pieces(moduli), _ddl(PART))
            .groupBy("row", "id", "tkey", "n_cp", "sha")
            .agg(F.sum("n_bytes").alias("n_bytes"), (F.sum("f1") % moduli[0]).alias("f1"),
                 (F.sum("f2") % moduli[1]).alias("f2")))
    return short.unionByName(long.withColumn("row", -F.col("row") - 1))


def _chunks(batches):
    for b in batches:
        ids, keys = b.column("id").to_pylist(), b.column("tkey").to_pylist()
        for i, t in enumerate(strings_of(b.column("text"))):
            t = t.translate(None, WHITE)
            at = range(0, max(1, len(t)), CHUNK)
            yield record(BYTES, [ids[i]] * len(at), [keys[i]] * len(at), list(range(len(at))), [t[a:a + CHUNK] for a in at])


def _same_as_smallest(rows: DataFrame, members: DataFrame) -> DataFrame:
    """members (id, tkey, f1, f2, n_bytes): with those of its group's smallest row, and
    whether all chunks are equal."""
    group = ["f1", "f2", "n_bytes"]
    first = members.groupBy(*group).agg(F.min("id").alias("id"))
    first = members.join(first, [*group, "id"]).groupBy(*group, "id").agg(F.min("tkey").alias("tkey"))
    # always by sorting: texts are as large as the corpus, and so may their copies be
    texts = rows.withColumn("tkey", text_key()).join(members.select("id", "tkey").hint("merge"), ["id", "tkey"], "left_semi")
    chunks = texts.select("id", "tkey", "text").mapInArrow(_chunks, _ddl(BYTES))
    keyed = chunks.join(members, ["id", "tkey"])
    mine = keyed.select(*group, "chunk_no", "id", "tkey", "chunk")
    # a repeated row gives its chunks once
    theirs = (chunks.join(first, ["id", "tkey"]).groupBy(*group, "chunk_no")
              .agg(F.first("chunk").alias("first_chunk"), F.min("id").alias("cls_id"), F.min("tkey").alias("cls_key")))
    return (mine.join(theirs, [*group, "chunk_no"])
            .groupBy("id", "tkey", *group, "cls_id", "cls_key")
            .agg(F.min((F.col("chunk") == F.col("first_chunk")).cast("int")).alias("same")))


def classes(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, tkey, cls_id, cls_key) of the rows that share fingerprint and length with
    another text row; cls is the smallest row with an equal text."""
    group = ["f1", "f2", "n_bytes"]
    distinct = parts.select("id", "tkey", *group).distinct()
    shared = parts.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = store(distinct.join(shared, group), "op3-members")
    found = []
    while not members.isEmpty():
        checked = store(_same_as_smallest(rows, members), "op3-checked")
        found.append(checked.where("same = 1").select("id", "tkey", "cls_id", "cls_key"))
        members = checked.where("same = 0").select("id", "tkey", *group)
    return reduce(DataFrame.unionByName, found) if found else None


def exact_dedup(docs: DataFrame, moduli=MODULI, parallel_bytes: int = PARALLEL_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (and n_chars).

    Of equal texts the row with most code points in the original, then the smallest
    doc_id stays, and of repeated rows one.  Null and empty texts are one group; a null
    doc_id comes last; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    rows = doc_rows(docs)
    parts = store(summaries(rows, moduli, parallel_bytes), "op3-parts")
    same = classes(rows, parts)
    if same is None:
        named = parts.withColumn("cls_id", F.col("id")).withColumn("cls_key", F.col("tkey"))
    else:
        named = (parts.join(same, ["id", "tkey"], "left")
                 .withColumn("cls_id", F.coalesce("cls_id", "id"))
                 .withColumn("cls_key", F.coalesce("cls_key", "tkey")))
    best = named.groupBy("cls_id", "cls_key").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_cp")).alias("k"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("best"))
    return named.join(best, ["cls_id", "cls_key"]).select(
        as_doc_id().alias("doc_id"), F.expr(f"nullif(best.id, {(1 << 63) - 1})").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("n_cp").alias("n_chars"))
