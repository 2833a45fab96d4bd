"""Language ID by nearest centroid (operator 7).

A text becomes a normalised TF-IDF vector of hashed letter n-grams.  Each language has
several centroids, clustered by spherical k-means from a bounded sample of labelled
texts; the language of the closest centroid by cosine wins.  A text is rejected when it
has no letter, or is further from its centroid than nearly all clean texts of its size.
Size is the number of distinct n-grams, as a text with few of them (short, or a word over
and over) is far by nature.  The bounds come from the labelled sample: each text and its
leading pieces are compared with the centroids less the text itself, and a low quantile
(``CUT``) of the cosines of each language and size, times ``SLACK``, is the bound.  So about
``CUT`` of clean texts, at most, are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_doc_id, doc_rows, record, small_batches, slices, store, strings_of, text_key, utf8

DIMS = 4096                  # hashed n-gram space
SAMPLE_PER_LANG = 2000       # labelled texts per language to learn from, on average
CENTROIDS = 4                # per language
ROUNDS = 8                   # of k-means
PIECES = [1 << n for n in range(2, 13)]      # leading bytes of a labelled text that show what shorter texts score
CUT = 0.001                  # quantile of the clean cosines of a language and size
SLACK = 0.9                  # a text is too far with less than this part of that quantile
ENOUGH = 20                  # cosines that a language and size need for a bound of their own
SIZES = 25                   # two size classes for each doubling of the n-grams, up to DIMS
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")

VECTOR = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("vec", pa.binary()), ("head", pa.binary())])
CENTROID = pa.schema([("lang", pa.string()), ("c", pa.int32()), ("mass", pa.float64()), ("vec", pa.binary())])
CLEAN = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("cos", pa.float64())])
LABEL = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                   ("score", pa.float64()), ("rejected", pa.bool_())])


def _prepared(texts: pa.Array) -> pa.Array:
    """Lower case, one space around each word: n-grams then mark word edges."""
    return pa.array([" " + NOT_LETTERS.sub(" ", t.decode("utf-8", "replace").lower()).strip() + " "
                     for t in strings_of(texts)], pa.large_string())


def counts(texts: pa.Array, dims: int = DIMS):
    """Yields (a, b, matrix): n-gram counts of rows a to b, n-grams of 2 to 4 bytes."""
    data, offsets = utf8(texts)
    # a matrix of few rows at a time, whatever the texts' sizes
    sizes = np.maximum(np.diff(offsets), 4 * dims)
    for a, b in slices(sizes):
        out = np.zeros((b - a) * dims)
        step = 1 << 22                     # a very long text is counted in pieces
        for lo in range(int(offsets[a]), max(int(offsets[b]), int(offsets[a]) + 1), step):
            hi = min(lo + step, int(offsets[b]))
            end = min(hi + 3, int(offsets[b]))
            part = data[lo:end].astype(np.uint64)
            row = np.searchsorted(offsets[a + 1:b + 1], np.arange(lo, end), side="right")
            h = part.copy()
            for n in (2, 3, 4):
                if len(part) < n:
                    break
                h = h[:len(part) - n + 1] * np.uint64(257) + part[n - 1:]
                mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                starts = min(hi - lo, len(h))
                same = row[:starts] == row[n - 1:n - 1 + starts]
                out += np.bincount((row[:starts] * dims + (mixed[:starts] % np.uint64(dims)).astype(np.int64))[same],
                                   minlength=len(out))
        yield a, b, out.reshape(b - a, dims)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _vectors(m: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(m) * idf)


def _sizes(m: np.ndarray) -> np.ndarray:
    """Size class of each row by its number of distinct n-grams."""
    return (2 * np.log2(np.maximum((m > 0).sum(axis=1), 1))).astype(int).clip(0, SIZES - 1)


def sample(rows: DataFrame, per_lang: int) -> DataFrame:
    """Labelled rows by a hash of the id: about ``per_lang`` of each language."""
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for lang, count in n.items():
        share = int(min(1.0, per_lang / count) * (1 << 30))
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("id", text_key()), F.lit(1 << 30)) < share))
    return rows.where(keep)


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, k: int = CENTROIDS):
    """(languages, centroids, bounds of each centroid's language by size, idf); learns from labelled
    rows whose crc32(doc_id) mod 5 is not 0, never from held-out ones."""
    rows = docs.select("doc_id", *[F.col(c) for c in ("text", "lang")]).where("doc_id is not null and lang is not null and text is not null")
    rows = rows.where("crc32(cast(doc_id as string)) % 5 != 0").select(F.col("doc_id").alias("id"), "text", "lang")

    def vectors(batches):
        for b in batches:
            langs, ids = b.column("lang").to_pylist(), b.column("id").to_pylist()
            texts = _prepared(b.column("text"))
            for lo, hi, m in counts(texts):
                heads = [t[:PIECES[-1]] for t in strings_of(texts[lo:hi])]
                yield record(VECTOR, langs[lo:hi], ids[lo:hi], [r.astype(np.float32).tobytes() for r in m], heads)

    taken = store(sample(rows, per_lang).mapInArrow(vectors, "lang string, order long, vec binary, head binary"), "op7-sample")

    def document_counts(batches):
        seen, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for v in b.column("vec").to_pylist():
                seen += np.frombuffer(v, np.float32) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(DIMS + 1), pa.int32()),
                                          "n": pa.array([*seen.tolist(), n], pa.int64())})

    df = taken.select("vec").mapInArrow(document_counts, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(DIMS + 1)
    for r in df:
        seen[r["dim"]] = r["n"]
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1

    def cluster(group: pa.Table) -> pa.Table:
        lang = group.column("lang")[0].as_py()
        order = np.argsort(group.column("order").to_numpy(), kind="stable")
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float32).reshape(-1, DIMS)[order]
        x = _vectors(x, idf)
        c = _unit(x.mean(axis=0, keepdims=True))
        for _ in range(1, min(k, len(x))):         # the farthest text starts the next centroid
            c = np.vstack([c, x[np.argmin((x @ c.T).max(axis=1))]])
        for _ in range(ROUNDS):
            near = (x @ c.T).argmax(axis=1)
            c = _unit(np.vstack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
        near = (x @ c.T).argmax(axis=1)
        mass = [float(np.linalg.norm(x[near == j].sum(axis=0))) for j in range(len(c))]
        return pa.table({"lang": [lang] * len(c), "c": pa.array(range(len(c)), pa.int32()), "mass": mass,
                         "vec": [v.astype(np.float32).tobytes() for v in c]}, schema=CENTROID)

    found = taken.select("lang", "order", "vec").groupBy("lang").applyInArrow(cluster, "lang string, c int, mass double, vec binary").collect()
    found.sort(key=lambda r: (r["lang"], r["c"]))
    centroids = np.array([np.frombuffer(r["vec"], np.float32) for r in found], np.float64).reshape(len(found), DIMS)
    langs = [r["lang"] for r in found]
    return langs, centroids, bounds(taken, langs, centroids, np.array([r["mass"] for r in found]), idf), idf


def bounds(taken: DataFrame, langs: list[str], centroids: np.ndarray, mass: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """``CUT`` quantile of the cosines of clean texts, per centroid (its language's) and size."""
    out = np.zeros((len(langs), SIZES))
    if not langs:
        return out
    shared = taken.sparkSession.sparkContext.broadcast((langs, centroids, mass, idf))

    def clean(batches):
        langs, centroids, mass, idf = shared.value
        of = np.array(langs)

        def cosines(labels, vec, pieces, row):
            """Of the pieces (counts) of texts ``row``, whose own part is taken out of their centroids."""
            x = _vectors(vec, idf)
            own = np.where(of[None, :] == labels[:, None], x @ centroids.T, -2).argmax(axis=1)
            left = np.sqrt(np.maximum(mass[own] ** 2 - 2 * mass[own] * (x * centroids[own]).sum(axis=1) + 1, 0))
            v = _vectors(pieces, idf)
            cos = v @ centroids.T
            at = np.arange(len(v)), own[row]
            less = (mass[own][row] * cos[at] - (v * x[row]).sum(axis=1)) / np.maximum(left[row], 1e-12)
            cos[at] = np.where(left[row] > 1e-3, less, -1)
            near = cos.argmax(axis=1)
            right = of[near] == labels[row]            # of a wrong language it says nothing
            return record(CLEAN, labels[row][right].tolist(), _sizes(pieces)[right].astype(np.int32), cos.max(axis=1)[right])

        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.slice(lo, 64)
                labels, heads = np.array(part.column("lang").to_pylist()), part.column("head").to_pylist()
                vec = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.float32).reshape(-1, DIMS).astype(float)
                lettered = np.flatnonzero([bool(LETTER.search(h.decode("utf-8", "replace"))) for h in heads])
                if len(lettered):
                    yield cosines(labels, vec, vec[lettered], lettered)
                cut = [(i, heads[i][:n].decode("utf-8", "ignore")) for i in lettered for n in PIECES if n < len(heads[i])]
                for a, z, m in counts(pa.array([t for _, t in cut], pa.large_string())):
                    yield cosines(labels, vec, m, np.array([i for i, _ in cut[a:z]]))

    low = F.count("*").alias("n"), F.percentile("cos", F.lit(CUT)).alias("low")
    scored = store(taken.select("lang", "vec", "head").mapInArrow(clean, "lang string, size int, cos double"), "op7-clean")
    own = {(r["lang"], r["size"]): r["low"] for r in scored.groupBy("lang", "size").agg(*low).collect() if r["n"] >= ENOUGH}
    pooled = {r["size"]: r["low"] for r in scored.groupBy("size").agg(*low).collect() if r["n"] >= ENOUGH}
    for i, lang in enumerate(langs):
        mine = {size: v for (name, size), v in own.items() if name == lang} or pooled
        for size in range(SIZES):                      # a size seen too seldom has the bound of the one below it
            out[i, size] = mine.get(size, out[i, size - 1] if size else 0)
    return out


def _labels(texts: pa.Array, model, slack: float):
    """(language, score, rejected) arrays of the texts."""
    langs, centroids, low, idf = model
    n = len(texts)
    lettered = np.array([bool(LETTER.search(t.decode("utf-8", "replace"))) for t in strings_of(texts.fill_null(""))], bool)
    score, pred, out = np.zeros(n), [UNKNOWN] * n, np.ones(n, bool)
    if langs:
        for lo, hi, m in counts(_prepared(texts.fill_null(""))):
            cos = _vectors(m, idf) @ centroids.T
            near = cos.argmax(axis=1)
            score[lo:hi] = cos[np.arange(hi - lo), near].clip(0, 1)
            out[lo:hi] = score[lo:hi] < slack * low[near, _sizes(m)]
            for i, j in enumerate(near):
                pred[lo + i] = langs[j]
    score[~lettered], out[~lettered] = 0, True
    return [p if ok else UNKNOWN for p, ok in zip(pred, lettered)], score, out


def predict(docs: DataFrame, model, slack: float = SLACK) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)       # CENTROIDS x DIMS a language

    def label(batches):
        for b in batches:
            yield record(LABEL, b.column("id"), b.column("held_out"), *_labels(b.column("text"), shared.value, slack))

    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(True))
    return doc_rows(docs, held.alias("held_out")) \
        .mapInArrow(label, "id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, slack: float = SLACK) -> DataFrame:
    """The rows of ``docs`` that are not rejected, as they are; it learns from ``docs``.
    If no row is labelled there is nothing to compare with, and lettered texts stay."""
    small_batches(docs.sparkSession)
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for b in batches:
            pred, _, out = _labels(b.column(b.schema.names.index("text")), shared.value, slack)
            if not shared.value[0]:
                out = np.array([not LETTER.search((t or "")) for t in b.column(b.schema.names.index("text")).to_pylist()], bool)
            yield b.filter(pa.array(~out))

    return docs.mapInArrow(keep, docs.schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected.

    ``und`` with score 0 for a null text or one without a letter, and for every text when
    no row is labelled.  Rejection shows in ``rejected`` alone; lang_pred stays the
    nearest language.  Rows without an id or a language teach nothing and are predicted
    like the others (no id: held out); repeated rows get equal answers."""
    small_batches(docs.sparkSession)
    return predict(docs, fit(docs)).select(as_doc_id().alias("doc_id"), "held_out", "lang_pred", "score", "rejected")
