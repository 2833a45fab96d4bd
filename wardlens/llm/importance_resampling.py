"""Target-distribution importance resampling (operator 13).

A document's features (runs of words) fall into hashed buckets.  A bucket's gain is the
logarithm of its share in the target over its share in the corpus; the gains are one
bounded array, and a document's weight is the mean gain of its features.  With noise drawn
from its id, the documents of highest score are a sample without replacement in
proportion to the weights.

The cutoff is found without sorting the corpus: a quantile sketch of the scores gives a
bracket around it, exact counts above and in the bracket tell whether the cutoff lies in
it (if not, the bracket is widened), and only the bracket's rows are sorted to find the
last document drawn.  Ranks then come from a range-partitioned sort of the drawn
documents.

A document without words has no feature, weighs 0, and is not drawn below ``min_words``;
null texts count as empty.  Repeated rows are rows of their own.  A null doc_id is null in
the result, is hashed as an empty string and comes last among equal scores.  Whole texts
are read; further columns are not; an empty table gives an empty result, an empty target
the gains that the formula has for no features.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_doc_id, doc_rows, record, small_batches, store, utf8

BUCKETS, RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SKETCH = 1000                  # accuracy of the quantile sketch: its ranks err by 1 / SKETCH at most
WIDTH = 0.002                  # half of the first bracket, as a share of the rows
CACHE_RUNS = 300_000           # runs of words whose buckets a worker keeps

TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
CODED = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])
COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
WEIGHED = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


class _Buckets(dict):
    """Bucket of each run of words."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        if len(self) > CACHE_RUNS:
            self.clear()
        found = self[run] = zlib.crc32(run) % self.buckets
        return found


def _codes(raw: bytes, of: _Buckets, run: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``run`` of them."""
    words = raw.split()
    parts = [np.fromiter(map(of.__getitem__, words), np.uint32, len(words))]
    for n in range(2, run + 1):
        runs = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
        parts.append(np.fromiter(map(of.__getitem__, runs), np.uint32, len(runs)))
    return len(words), np.concatenate(parts)


def features(docs: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(id, n_words, n_features, buckets): the bucket of each feature, as packed 16-bit
    numbers (32-bit for more than 65,536 buckets)."""
    small_batches(docs.sparkSession)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def go(batches):
        of = _Buckets(buckets)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            raw = data.tobytes().translate(TABLE)
            coded = [_codes(raw[a:b], of, run) for a, b in zip(at, at[1:])]
            yield record(CODED, batch.column("id"), [n for n, _ in coded], [len(c) for _, c in coded],
                         [c.astype(kind).tobytes() for _, c in coded])

    return doc_rows(docs).mapInArrow(go, "id long, n_words long, n_features long, buckets binary")


def _codes_of(batch: pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a batch, and where each row's begin."""
    data, at = utf8(batch.column("buckets"))
    return np.frombuffer(data.tobytes(), kind), at // np.dtype(kind).itemsize


def bucket_counts(coded: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket; the result is as long as there are buckets."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def go(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_codes_of(batch, kind)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield record(COUNTS, at.astype(np.int32), total[at])

    out = np.zeros(buckets, np.int64)
    for r in coded.select("buckets").mapInArrow(go, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the corpus)) of each bucket, one
    feature added to every bucket."""
    buckets = len(corpus)
    in_corpus, in_target = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(t + 1) * in_corpus / (float(s + 1) * in_target)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(coded: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each row's features."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    held = coded.sparkSession.sparkContext.broadcast(gain)

    def go(batches):
        gain = held.value
        for batch in batches:
            codes, at = _codes_of(batch, kind)
            upto = np.concatenate([[0], np.cumsum(gain[codes])])
            n = np.diff(at)
            yield record(WEIGHED, batch.column("id"), batch.column("n_words"), batch.column("n_features"),
                         (upto[at[1:]] - upto[at[:-1]]) // np.maximum(n, 1))

    return coded.mapInArrow(go, "id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise times 1000, floored, from the hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(as_doc_id().cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _numbered(df: DataFrame, order: list[Column], column: str) -> DataFrame:
    """Rows numbered from 1 in ``order``, sorted in range partitions; only the number of
    rows of each partition comes to the driver.  ``order`` must be total."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = store(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                 .withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33).cast("int")
    before, offsets = 0, []
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r.part, before))
        before += r["count"]
    offset = spark.createDataFrame(offsets, "_part int, _before long")
    return rows.withColumn("_part", part).join(F.broadcast(offset), "_part") \
        .withColumn(column, F.col("_before") + (F.col("_place").bitwiseAND((1 << 33) - 1)) + 1) \
        .drop("_place", "_part", "_before")


def _order() -> list[Column]:
    """Highest score first; a total order, as ``row`` differs from row to row."""
    return [F.desc("score"), F.asc("id"), F.asc("row")]


def cutoff(scored: DataFrame, rows: int, draw: int) -> tuple[int, int, int]:
    """(score, id, row) of the ``draw``-th of ``rows`` rows in order, 1 <= draw <= rows."""
    share, width = 1 - draw / rows, WIDTH
    while True:
        sides = [max(0.0, share - width), min(1.0, share + width)]
        low, high = scored.agg(F.percentile_approx("score", sides, SKETCH)).first()[0]
        if sides[0] == 0.0 or sides[1] == 1.0:   # the sketch's ends are not exact
            ends = scored.agg(F.min("score"), F.max("score")).first()
            low, high = ends[0] if sides[0] == 0.0 else low, ends[1] if sides[1] == 1.0 else high
        above, upto = scored.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if above < draw <= upto:
            break
        width *= 4
    bracket = _numbered(scored.where(F.col("score").between(low, high)).select("score", "id", "row"), _order(), "place")
    return tuple(bracket.where(F.col("place") == draw - above).select("score", "id", "row").first())


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every row of ``docs`` (doc_id, text);
    of those with ``min_words`` words the ``percent`` of highest score have a rank, from 1.
    target: rows with a text."""
    coded = store(features(docs, buckets, run), "resample-features")
    wanted = features(target.select(F.lit(0).alias("doc_id"), "text"), buckets, run)
    gain = gains(bucket_counts(coded, buckets), bucket_counts(wanted, buckets))
    scored = store(weigh(coded, gain).withColumn("score", F.col("weight") + noise(seed))
                   .withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    able = scored.where(F.col("n_words") >= min_words)
    rows = able.count()
    draw = percent * rows // 100
    out = [as_doc_id().alias("doc_id"), "n_features", "weight", "score"]
    if not draw:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last_score, last_id, last_row = cutoff(able, rows, draw)
    drawn = (F.col("n_words") >= min_words) & (
        (F.col("score") > last_score) | (F.col("score") == last_score) & (
            (F.col("id") < last_id) | (F.col("id") == last_id) & (F.col("row") <= last_row)))
    return scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(
        _numbered(scored.where(drawn), _order(), "rank").select(*out, "rank"))


ORACLE_SQL = r"""
    WITH RECURSIVE
         bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i)
                  UNION ALL
                  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
         crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
         docs AS (SELECT row_number() OVER () AS row_no, doc_id,
                         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
         items AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
         tf AS (SELECT row_no, word, count(*) AS n FROM (SELECT row_no, unnest(words) AS word FROM docs) GROUP BY ALL),
         words AS (SELECT DISTINCT word FROM (SELECT word FROM tf UNION ALL SELECT word FROM items)),
         coded AS (SELECT word, hex(encode(word)) AS x FROM words),
         crc AS (SELECT word, xor(4294967295, list_reduce(
                            list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2),
                                lambda i: ((strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16
                                           + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
                            lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)))::BIGINT % 10000 AS bucket
                 FROM coded CROSS JOIN crc_table),
         s AS (SELECT bucket, sum(n)::BIGINT AS s FROM tf JOIN crc USING (word) GROUP BY bucket),
         t AS (SELECT bucket, count(*) AS t FROM items JOIN crc USING (word) GROUP BY bucket),
         gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
                                / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
                  FROM s LEFT JOIN t USING (bucket)),
         weight AS (SELECT row_no, floor(sum(n * gain)::HUGEINT::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
                    FROM tf JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY row_no),
         scored AS (SELECT row_no, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
                           coalesce(weight, 0) + floor(-1000 * ln(-ln(
                               (('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
                    FROM docs LEFT JOIN weight USING (row_no)),
         ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (
                               PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, row_no) END AS r FROM scored)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN r <= (10 * (SELECT count(*) FROM scored WHERE n_features >= 20)) // 100 THEN r END AS rank
    FROM ranked"""
