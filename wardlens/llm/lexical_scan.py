"""Ranked lexical search by scanning the documents (operator 12).

Every term of all items goes into one Aho-Corasick automaton, between guards (the space
that stands for any character outside terms), so that a hit is always a whole term.  Texts
run through it once, with no index of the documents; a hit's term leads to the items that
hold it.  The scan stores each document's number of terms and its counts of the items'
terms; document frequencies are aggregated from these, and a second pass scores, keeping
in each task the best of each item.  Only those are compared between tasks.

Items go to the tasks in blocks of bounded size; more items than a block holds mean more
scans, each of all documents against a block.

Null texts hold no term; documents without any term do not count.  Repeated rows of
documents are documents of their own.  Rows of one item_id (or of none) are one item, with
the terms of all its rows; items without terms, or whose terms no document has, give no
rows.  Documents without id come after all others at equal score.  Texts are scanned whole;
further columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, as_doc_id, doc_rows, record, small_batches, store, utf8

KEEP = 50
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 4_000      # of items that one scan takes
CELLS = 1 << 21                                # (document, item) scores at a time

# bytes of terms, A-Z lower-cased; everything else becomes the guard
TERM = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in TERM)
IS_TERM = np.frombuffer(TABLE, np.uint8) != 32

HITS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
BEST = pa.schema([("item", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order, repeats included."""
    return [t.decode() for t in (text or "").encode().translate(TABLE).split(b" ") if t]


_AUTOMATA: dict[str, object] = {}


def _automaton(key: str, terms: list[str]):
    """The automaton of a block; a worker keeps one."""
    if key not in _AUTOMATA:
        import ahocorasick
        found = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            found.add_word(f" {t} ", i)
        found.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = found
    return _AUTOMATA[key]


def _numbers_of_terms(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many terms each text holds."""
    inside = IS_TERM[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    starts[heads] = inside[heads]                # a text does not go on in the next
    upto = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
    return upto[at[1:]] - upto[at[:-1]]


def _lists(parts: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for p in parts for x in p], pa.int32()))


def scan(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(id, n, terms, tf): each document's number of terms, which of ``terms`` (their
    places in the list) it holds and how often."""
    small_batches(docs.sparkSession)
    key, held = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        found = _automaton(key, held.value)
        second = itemgetter(1)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            raw = data.tobytes().translate(TABLE)
            counts = [Counter(map(second, found.iter(f" {raw[a:b].decode()} "))) for a, b in zip(at, at[1:])]
            yield record(HITS, batch.column("id"), _numbers_of_terms(data, at),
                         _lists([list(c) for c in counts]), _lists([list(c.values()) for c in counts]))

    return doc_rows(docs).mapInArrow(run, "id long, n long, terms array<int>, tf array<int>")


class _Best:
    """The ``keep`` best documents of each item so far."""

    def __init__(self, items: int, keep: int):
        self.keep, self.items = keep, items
        self.least = np.ones(items, np.int64)            # a score below this cannot get in
        self.rows = [np.zeros(0, np.int64)] * 3          # item, id, score
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: documents x items."""
        d, i = np.nonzero(scores >= self.least)
        self.waiting.append((i, ids[d], scores[d, i]))
        self.held += len(i)
        if self.held > 4 * self.keep * self.items:
            self.cut()

    def cut(self) -> None:
        item, doc, score = (np.concatenate(c) for c in zip(self.rows, *self.waiting))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        first = np.searchsorted(item, np.arange(self.items))
        place = np.arange(len(item)) - first[item]
        last = place == self.keep - 1
        self.least[item[last]] = score[last]             # equal scores may have a smaller id
        stay = place < self.keep
        self.rows, self.waiting = [item[stay], doc[stay], score[stay]], []
        self.held = 0


def _scores(hits: DataFrame, weights: np.ndarray, first: np.ndarray, holds: np.ndarray, items: int,
            n_docs: int, n_terms: int, keep: int) -> DataFrame:
    """(item, id, score): the best of each task.  first, holds: for each term where its
    items begin in ``holds``, which lists them."""
    held = hits.sparkSession.sparkContext.broadcast((weights, first, holds))

    def run(batches):
        weights, first, holds = held.value
        many, best = np.diff(first), _Best(items, keep)
        for batch in batches:
            ids, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
            m = 50 + 50 * n * n_docs // n_terms
            ends = batch.column("terms").offsets.to_numpy()
            ends = (ends - ends[0]).astype(np.int64)
            term = batch.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), np.diff(ends))
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            step = max(1, CELLS // max(items, 1))
            for a in range(0, len(ids), step):
                b = min(a + step, len(ids))
                lo, hi = ends[a], ends[b]
                reps = many[term[lo:hi]]
                upto = np.cumsum(reps)
                if not len(upto) or not upto[-1]:
                    continue
                item = holds[np.repeat(first[term[lo:hi]] - (upto - reps), reps) + np.arange(upto[-1])]
                cell = np.repeat(doc[lo:hi] - a, reps) * items + item
                # sums stay far below 2^53 (a term adds less than 2^36), so doubles hold them
                total = np.bincount(cell, np.repeat(part[lo:hi], reps), (b - a) * items)
                best.add(ids[a:b], total.astype(np.int64).reshape(b - a, items))
        best.cut()
        item, doc, score = best.rows
        for a in range(0, len(item), 50_000):
            yield record(BEST, item[a:a + 50_000].astype(np.int32), doc[a:a + 50_000], score[a:a + 50_000])

    return hits.mapInArrow(run, "item int, id long, score long")


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_block(docs: DataFrame, rows: list, keep: int) -> DataFrame:
    """(item_id, id, score) of one block of items, rows: (item_id, text)."""
    spark = docs.sparkSession
    held: dict = {}
    for r in rows:
        held.setdefault(r.item_id, set()).update(terms_of(r.text))
    names = list(held)
    terms = sorted(set().union(*held.values()))
    if not terms:
        return spark.createDataFrame([], "item_id long, id long, score long")
    number = {t: i for i, t in enumerate(terms)}
    hits = store(scan(docs, terms), "lexical-hits")
    total = hits.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(terms), np.int64)                  # bounded: the terms of one block
    for r in hits.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r.t] = r.df
    weights = np.array([_weight(total.docs, int(x)) for x in df], np.int64)
    of_term: list[list[int]] = [[] for _ in terms]
    for i, name in enumerate(names):
        for t in held[name]:
            of_term[number[t]].append(i)
    first = np.cumsum([0, *map(len, of_term)])
    holds = np.array([i for x in of_term for i in x], np.int64)
    best = _scores(hits, weights, first, holds, len(names), total.docs, max(total.terms or 0, 1), keep)
    ids = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", "id", "score")


def _blocks(items: DataFrame) -> list[DataFrame]:
    """Items in blocks within BLOCK_BYTES and BLOCK_ITEMS, if no single item is larger."""
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("b"), F.countDistinct("item_id").alias("n")).first()
    if (size.b or 0) <= BLOCK_BYTES and size.n <= BLOCK_ITEMS:
        return [items]
    n = math.ceil(max(2 * size.b / BLOCK_BYTES, 2 * size.n / BLOCK_ITEMS))
    at = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return [items.where(at == i) for i in range(n)]


def search(docs: DataFrame, items: DataFrame, keep: int = KEEP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``keep`` best documents (doc_id, text) of each
    item (item_id, text), best first, equal scores by doc_id."""
    items = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for block in _blocks(items):
        part = _search_block(docs, block.collect(), keep)    # bounded by the block's size
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep) \
        .select("item_id", "rank", as_doc_id("id").alias("doc_id"), "score")


ORACLE_SQL = r"""
    WITH docs AS (SELECT doc_id, row_number() OVER () AS row_no,
                         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
         totals AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM docs),
         wanted AS (SELECT DISTINCT item_id,
                           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
         tf AS (SELECT row_no, doc_id, len(words) AS n, term, count(*) AS tf
                FROM (SELECT row_no, doc_id, words, unnest(words) AS term FROM docs) GROUP BY ALL),
         df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
         part AS (SELECT row_no, doc_id, term,
                         floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                           * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS part
                  FROM tf JOIN df USING (term) CROSS JOIN totals),
         scored AS (SELECT item_id, row_no, doc_id, sum(part)::BIGINT AS score
                    FROM part JOIN wanted USING (term) GROUP BY ALL HAVING sum(part) > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
    WHERE rank <= 50"""
