"""Suffix-array dedup by prefix-free parsing (operator 1).

A byte is removed if a string of ``LENGTH`` bytes over it also starts in a document with a
smaller id.

* Parsing.  The trigger of a string is its ``GRAM``-byte substring of smallest rolling hash
  (the first of equal ones), so equal strings have the same trigger, wherever they stand.
  A phrase is a run of string starts with one trigger, together with the bytes that their
  strings cover; its right context makes the parse's next phrases part of it.  Texts are
  phrases end to end; the different phrases are the dictionary.
* Dictionary.  A phrase that also stands in a smaller document is removed whole.  Of each
  phrase the smallest document goes on, and only if its trigger belongs to several phrases:
  strings with a trigger of one phrase stand nowhere else.  Texts that repeat shrink to
  their dictionary here; texts that do not are gone.
* Suffix array.  The suffixes of the phrases left, at the places where their strings start,
  are sorted by trigger and their first LENGTH bytes, which is the order of the corpus
  suffixes; neighbours with LENGTH bytes in common are equal strings, and all but those of
  the smallest document are removed.

Phrases travel packed: a row holds one batch's phrases of one bucket.  A batch sends a
phrase once; a trigger with many phrases in a batch is dealt by phrase, and only a mark
by trigger, so no trigger or phrase gathers in a task.  Likewise a trigger with more than
``HOT`` phrases goes into the sort string by string, dealt by the string's bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, SLICE_BYTES, as_doc_id, doc_rows, record, slices, small_batches, store, strings_of, text_key, utf8
from .shingles import mix, powers

LENGTH, GRAM = 50, 20
FLUSH = 4 << 20             # text bytes whose phrases a task holds before it sends them
BUCKET_BYTES = 16 << 20     # text bytes, on average, whose phrases a task receives at a time
BIN_DOCS = 4096             # documents, on average, whose findings a task puts together at a time
MANY = 64                   # phrases of a trigger in one batch that are dealt by phrase
HOT = 10_000                # phrases of a trigger that are sorted string by string
SORT_STRINGS = 300_000      # strings sorted at a time

REMOVED, OPEN = 0, 1
PLAIN, SPREAD, MARK = 0, 1, 2
PACK = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("h", "u", "id", "tkey", "place", "flag"))])
PACK_DDL = "bucket long, h binary, u binary, id binary, tkey binary, place binary, flag binary"
FOUND = pa.schema([("bin", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("id", "tkey", "h", "place"))])
FOUND_DDL = "bin long, kind int, id binary, tkey binary, h binary, place binary"
OWN = pa.schema([("id", pa.int64()), ("tkey", pa.int64()), ("kind", pa.int32()), ("h", pa.binary()), ("place", pa.binary())])
OWN_DDL = "id long, tkey long, kind int, h binary, place binary"
PHRASE = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("tkey", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())])
PHRASE_DDL = "h long, id long, tkey long, lo long, bytes binary"
SPANS = pa.schema([("id", pa.int64()), ("tkey", pa.int64()), ("spans", pa.binary())])
DIGEST = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


# --- parsing -----------------------------------------------------------------------

def _parse(data: np.ndarray, ends: np.ndarray):
    """Phrases of texts that stand end to end up to ``ends``: trigger hash, phrase hash,
    first string start, number of strings."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[:len(data) - GRAM + 1])
    # smallest hash of the grams of each string; its low bits tell the place
    least = (gram & ~np.uint64(63)) | (np.arange(len(gram), dtype=np.uint64) & np.uint64(63))
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    ends = ends[ends > 0]
    valid = np.zeros(len(least) + 1, np.int32)      # a string ends in the text where it starts
    np.add.at(valid, np.concatenate([[0], ends[:-1]]).clip(0, len(least)), 1)
    np.add.at(valid, np.maximum(ends - LENGTH + 1, np.concatenate([[0], ends[:-1]])).clip(0, len(least)), -1)
    start = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(start):
        return none
    trigger = start + ((least[start] & np.uint64(63)).astype(np.int64) - start & 63)
    first = np.ones(len(start), bool)
    first[1:] = (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(first)
    lo, n = start[at], np.diff(np.append(at, len(start)))
    phrase = mix((sums[lo + n + LENGTH - 1] - sums[lo]) * down[lo] + n.astype(np.uint64))
    return gram[trigger[at]], phrase, lo, n


def phrases_of(texts: pa.Array):
    """Yields (rows, trigger hashes, phrase hashes, starts, counts); a very long text comes
    in pieces."""
    data, offsets = utf8(texts)
    for a, b in slices(np.diff(offsets)):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= 2 * SLICE_BYTES:
            h, u, at, n = _parse(data[lo:hi], offsets[a + 1:b + 1] - lo)
            row = np.searchsorted(offsets[a + 1:b + 1] - lo, at, side="right")
            yield a + row, h, u, at - (offsets[a:b] - lo)[row], n
            continue
        for s in range(lo, hi, SLICE_BYTES):
            part = data[s:min(s + SLICE_BYTES + LENGTH - 1, hi)]
            h, u, at, n = _parse(part, np.array([len(part)]))
            yield np.full(len(h), a), h, u, at + (s - lo), n


def _by_document(ids, tkeys, *columns):
    """(id, tkey, bytes of each column's part) of every document."""
    order = np.lexsort((tkeys, ids))
    ids, tkeys = ids[order], tkeys[order]
    cut = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tkeys[1:] != tkeys[:-1])]) if len(ids) else np.zeros(0, np.int64)
    sorted_columns = [c[order] for c in columns]
    for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(ids)).tolist()):
        yield int(ids[lo]), int(tkeys[lo]), *(c[lo:hi].tobytes() for c in sorted_columns)


def _send(buckets: int, many: int):
    """Packed phrases by bucket; phrases known to be in a smaller document of the batch are
    sent for removal under bucket -1."""
    def flush(held):
        h, u, ids, tkeys, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((ids, u, h))
        h, u, ids, tkeys, place = (c[order] for c in (h, u, ids, tkeys, place))
        new_h = np.r_[True, h[1:] != h[:-1]]
        new = new_h | np.r_[True, u[1:] != u[:-1]]
        smallest = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = ids > smallest
        if late.any():
            yield record(PACK, [-1], [h[late].tobytes()], [b""], *([c[late].tobytes()] for c in (ids, tkeys, place)), [b""])
        of_h = np.cumsum(new_h) - 1
        phrases = np.bincount(of_h, weights=new)[of_h]
        flag = np.where(phrases > many, SPREAD, PLAIN).astype(np.uint8)
        mark = new_h & (flag == SPREAD)
        keep = ~late
        cols = [np.concatenate([c[keep], c[mark]]) for c in (h, u, ids, tkeys, place)]
        flag = np.concatenate([flag[keep], np.full(mark.sum(), MARK, np.uint8)])
        spread = np.where(flag == SPREAD, mix(cols[0] ^ mix(cols[1])), mix(cols[0]))
        bucket = (spread % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((cols[3], cols[2], bucket))        # documents together: they pack well
        bucket, flag, cols = bucket[order], flag[order], [c[order] for c in cols]
        cut = np.searchsorted(bucket, np.unique(bucket))
        ends = np.append(cut[1:], len(bucket))
        yield record(PACK, bucket[cut], *([c[x:y].tobytes() for x, y in zip(cut, ends)] for c in (*cols, flag)))

    def run(batches):
        held, size = [], 0
        for b in batches:
            ids, tkeys = b.column("id").to_numpy(), b.column("tkey").to_numpy()
            for row, h, u, lo, n in phrases_of(b.column("text")):
                if len(h):
                    held.append((h, u, ids[row], tkeys[row], (lo << 5) | (n - 1)))
                    size += int(n.sum())
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
    return run


# --- dictionary --------------------------------------------------------------------

def _dictionary(bins: int):
    """Rows by bucket: the phrases to remove, and those still open, packed by document bin."""
    kinds = {"h": np.uint64, "u": np.uint64, "id": np.int64, "tkey": np.int64, "place": np.int64, "flag": np.uint8}

    def unpack(rows, names):
        return [np.frombuffer(b"".join(c), kinds[n]) for n, c in zip(names, zip(*rows))]

    def packed(kind, h, ids, tkeys, place):
        if len(h):
            at = (mix(ids.view(np.uint64)) % np.uint64(bins)).astype(np.int64)
            order = np.lexsort((tkeys, ids, at))
            at, cols = at[order], [c[order] for c in (ids, tkeys, h, place)]
            cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            ends = np.append(cut[1:], len(at))
            yield record(FOUND, at[cut], [kind] * len(cut), *([c[x:y].tobytes() for x, y in zip(cut, ends)] for c in cols))

    def finish(held):
        h, u, ids, tkeys, place, flag = unpack(held, kinds)
        order = np.lexsort((ids, u, h))
        h, u, ids, tkeys, place, flag = (c[order] for c in (h, u, ids, tkeys, place, flag))
        real = flag != MARK
        new_h = np.r_[True, h[1:] != h[:-1]]
        new = new_h | np.r_[True, u[1:] != u[:-1]]
        group = np.cumsum(new) - 1
        smallest = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, group[real], ids[real])
        late = real & (ids > smallest[group])
        of_h = np.cumsum(new_h) - 1
        several = (np.bincount(of_h, weights=new) > 1) | (np.bincount(of_h, weights=flag == MARK) > 0)
        still = real & ~late & (several[of_h] | (flag == SPREAD))
        for kind, pick in ((REMOVED, late), (OPEN, still)):
            yield from packed(kind, h[pick], ids[pick], tkeys[pick], place[pick])

    def run(batches):
        bucket, held = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in PACK.names]
            for x, *row in zip(*cols):
                if x == -1:                             # known to the sender
                    h, ids, tkeys, place = unpack([(row[0], *row[2:5])], ("h", "id", "tkey", "place"))
                    yield from packed(REMOVED, h, ids, tkeys, place)
                    continue
                if x != bucket:
                    if held:
                        yield from finish(held)
                    bucket, held = x, []
                held.append(row)
        if held:
            yield from finish(held)
    return run


def _by_bin(batches):
    """Rows by bin: one row for each document and kind."""
    def finish(rows):
        for kind in (REMOVED, OPEN):
            mine = [r[1:] for r in rows if r[0] == kind]
            if mine:
                ids, tkeys, h, place = (np.frombuffer(b"".join(c), np.int64) for c in zip(*mine))
                docs = list(_by_document(ids, tkeys, h, place))
                for lo in range(0, len(docs), 1000):
                    i, k, hs, ps = zip(*docs[lo:lo + 1000])
                    yield record(OWN, i, k, [kind] * len(i), hs if kind == OPEN else [b""] * len(i), ps)

    at, rows = None, []
    for b in batches:
        for x, *row in zip(*(b.column(c).to_pylist() for c in FOUND.names)):
            if x != at:
                if rows:
                    yield from finish(rows)
                at, rows = x, []
            rows.append(row)
    if rows:
        yield from finish(rows)


# --- suffix array ------------------------------------------------------------------

def _open_phrases(batches):
    """The bytes of the open phrases of each text."""
    for b in batches:
        texts = strings_of(b.column("text"))
        for text, i, k, hs, ps in zip(texts, *(b.column(c).to_pylist() for c in ("id", "tkey", "h", "place"))):
            h, place = np.frombuffer(hs, np.int64), np.frombuffer(ps, np.int64)
            lo, n = place >> 5, (place & 31) + 1
            yield record(PHRASE, h, np.full(len(h), i), np.full(len(h), k), lo,
                         [text[s:e] for s, e in zip(lo.tolist(), (lo + n + LENGTH - 1).tolist())])


def _strings(batches):
    """Phrases of hot triggers, string by string.  Of equal strings in a batch those of the
    smallest document go on; the others are late, and need no bytes."""
    for b in batches:
        cols = [b.column(c).to_pylist() for c in PHRASE.names]
        rows = [(h, i, k, lo + j, x[j:j + LENGTH]) for h, i, k, lo, x in zip(*cols) for j in range(len(x) - LENGTH + 1)]
        smallest: dict = {}
        for h, i, _, _, x in rows:
            if i < smallest.get((h, x), NO_ID + 1):
                smallest[h, x] = i
        rows = [(h, i, k, lo, x if i == smallest[h, x] else b"") for h, i, k, lo, x in rows]
        yield record(PHRASE, *(zip(*rows) if rows else [[]] * 5))


def suffix_order(h: np.ndarray, ids: np.ndarray, data: np.ndarray, at: np.ndarray):
    """The order of the strings that start at ``at``, by (trigger, bytes, id), and where in
    it a different string begins."""
    padded = np.zeros((len(at), -(-LENGTH // 8) * 8), np.uint8)
    padded[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]
    columns = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((ids, *columns.T[::-1], h))
    x, y = order[1:], order[:-1]
    new = np.r_[True, (h[x] != h[y]) | (columns[x] != columns[y]).any(axis=1)]
    return order, new


def _earlier(batches):
    """Rows by (h, sub): the spans of phrases whose strings stand in a smaller document."""
    def finish(rows):
        hs, ids, tkeys, los, pieces = zip(*rows)
        sizes = np.array([len(p) for p in pieces])
        n = sizes - LENGTH + 1
        piece = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(sizes) - sizes, n) + inner
        own = np.array(ids, np.int64)[piece]
        order, new = suffix_order(np.array(hs, np.int64)[piece], own, np.frombuffer(b"".join(pieces), np.uint8), at)
        smallest = own[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = np.empty(len(order), bool)
        hit[order] = own[order] > smallest
        place = np.flatnonzero(hit)
        if not len(place):
            return
        start = np.array(los, np.int64)[piece[place]] + inner[place]
        cut = np.r_[True, (piece[place][1:] != piece[place][:-1]) | (start[1:] != start[:-1] + 1)]
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(place)) - 1
        spans = np.stack([start[first], start[last] + LENGTH], axis=1)
        of = piece[place][first]
        docs = list(_by_document(np.array(ids, np.int64)[of], np.array(tkeys, np.int64)[of], spans))
        i, k, s = zip(*docs)
        yield record(SPANS, i, k, s)

    group, rows, strings = None, [], 0
    for b in batches:
        for sub, *row in zip(*(b.column(c).to_pylist() for c in ("sub", *PHRASE.names))):
            if (row[0], sub) != group:
                if strings >= SORT_STRINGS:
                    yield from finish(rows)
                    rows, strings = [], 0
                group = row[0], sub
            rows.append(row)
            strings += len(row[4]) - LENGTH + 1
    if rows:
        yield from finish(rows)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of [start, end) spans."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def repeated_spans(docs: DataFrame, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, many: int = MANY) -> DataFrame:
    """docs rows (id, tkey, text) with what to remove, null for nothing: ``places`` of whole
    phrases and ``strings``, packed, and ``spans``, packed [start, end) byte pairs."""
    rows = doc_rows(docs).withColumn("tkey", text_key())
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    buckets, bins = max(1, -(-int(total["bytes"] or 0) // bucket_bytes)), max(1, -(-total["n"] // BIN_DOCS))
    sent = rows.select("id", "tkey", "text").mapInArrow(_send(buckets, many), PACK_DDL)
    # what is known already only passes through, dealt by what it is
    dealt = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.xxhash64("place"))
    found = store(sent.withColumn("dealt", dealt).repartition("dealt").sortWithinPartitions("bucket").drop("dealt")
                  .mapInArrow(_dictionary(bins), FOUND_DDL)
                  .repartition("bin").sortWithinPartitions("bin").mapInArrow(_by_bin, OWN_DDL), "op1-found")

    # always by sorting: open phrases are as many as the corpus makes them
    still = found.where(f"kind = {OPEN}").select("id", "tkey", "h", "place").hint("merge")
    phrases = store(rows.join(still, ["id", "tkey"]).select("id", "tkey", "text", "h", "place").mapInArrow(_open_phrases, PHRASE_DDL), "op1-phrases")
    counts = phrases.groupBy("h").agg(F.count("*").alias("n")).where(f"n > {hot}")
    cool = phrases.join(counts, "h", "left_anti").withColumn("sub", F.lit(0).cast("long"))
    warm = phrases.join(counts.select("h"), "h", "left_semi").mapInArrow(_strings, PHRASE_DDL)
    first = warm.where("octet_length(bytes) > 0").withColumn("sub", F.xxhash64("bytes"))
    later = (cool.unionByName(first).repartition("h", "sub").sortWithinPartitions("h", "sub")
             .mapInArrow(_earlier, "id long, tkey long, spans binary"))
    late = warm.where("octet_length(bytes) = 0").select("id", "tkey", F.col("lo").alias("string"))
    whole = found.where(f"kind = {REMOVED}").select("id", "tkey", "place")
    removed = whole.unionByName(later, allowMissingColumns=True).unionByName(late, allowMissingColumns=True).groupBy("id", "tkey").agg(
        F.collect_list("place").alias("places"), F.collect_list("spans").alias("spans"), F.collect_list("string").alias("strings"))
    removed = store(removed, "op1-spans")
    return rows.join(removed.hint("merge"), ["id", "tkey"], "left").select("id", "tkey", "text", "places", "spans", "strings")


def _digest(batches):
    for b in batches:
        out = [], [], [], []
        cols = (b.column(c).to_pylist() for c in ("places", "spans", "strings"))
        for text, places, spans, strings in zip(strings_of(b.column("text")), *cols):
            place = np.frombuffer(b"".join(places or []), np.int64)
            lo, string = place >> 5, np.array(strings or [], np.int64)
            cut = merged(np.concatenate([np.stack([lo, lo + (place & 31) + LENGTH], axis=1), np.stack([string, string + LENGTH], axis=1),
                                         np.frombuffer(b"".join(spans or []), np.int64).reshape(-1, 2)]))
            sha, at = hashlib.sha256(), 0
            for lo, hi in cut.tolist():
                sha.update(text[at:lo])
                at = hi
            sha.update(text[at:])
            for o, v in zip(out, (len(text), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), sha.hexdigest())):
                o.append(v)
        yield record(DIGEST, b.column("id"), *out)


def suffix_dedup(docs: DataFrame, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, many: int = MANY) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty; texts under 50 bytes keep all.  Repeats within one document, or
    between rows of one doc_id, remove nothing; repeated rows get equal results.  A null
    doc_id is larger than any other.  An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    return repeated_spans(docs, hot, bucket_bytes, many) \
        .mapInArrow(_digest, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string") \
        .select(as_doc_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
