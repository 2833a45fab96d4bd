"""Operators 11 to 13 against the public library, brute force and their contracts, on
fixtures with every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import documents, edge_rows, prose
from wardlens.llm import importance_resampling, lexical_scan, sentencepiece_codec
from wardlens.llm.sentencepiece_codec import Codec, Vocabulary, default_model

LAST = (1 << 63) - 1


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


# --- 11 ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


@pytest.fixture(scope="module")
def own():
    return Codec(default_model())


def test_codec_is_the_library_on_any_text(library, own):
    rng = random.Random(1)
    bits = ["a", " ", "  ", "th", "e", "\n", "\r", ");", "é", "日", "本", "▁", "😀", "\x00", "1", "23", "²", ".", "½", "in", "ing", "О", "н",
            "ß", "\t", "�", "À", "İ", "<s>", "</s>", "<0x0A>"]
    names = list(own.vocabulary.ids)
    texts = ["", " ", "\n", "x" * 1000, "ab" * 3000, "\r\n" * 50, *(" " * k for k in range(40)), *(t or "" for _, t in edge_rows())]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(names) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    for t in texts:
        ids = library.encode(t, add_eos=True)
        assert own.encode(t).tolist() == ids, t[:80]
        assert own.decode(np.array(ids)) == library.decode(ids)


def test_decode_of_any_ids(library, own):
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(262), rng.randrange(3, 259), 28705]) for _ in range(rng.randint(0, 6))]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_backtracking_gives_what_merging_gives():
    """Small vocabularies, ties among scores and pieces that merging never makes included."""
    rng = random.Random(3)
    for _ in range(300):
        pieces = {c: (i, -1000.0 - i) for i, c in enumerate("abc")}
        known, score = list("abc"), 0.0
        for _ in range(rng.randint(1, 14)):
            p = rng.choice(known) + rng.choice(known)
            if p not in pieces and len(p) < 9:
                score -= rng.choice([0.0, 1.0])
                pieces[p] = (len(pieces), score)
                known.append(p)
        v = Vocabulary(pieces)
        for _ in range(40):
            text = "".join(rng.choice("abcx") for _ in range(rng.randint(0, 24)))
            assert v.pieces(text) == v.merged(text), (pieces, text)


def test_compatibility_is_that_of_merging(own):
    rng, v = random.Random(4), own.vocabulary
    names = [p for p in v.halves if len(p) < 6]
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names)
        assert v.compatible(a, b) == (v.merged(a + b) == [a, b])


def test_sentencepiece_query(spark, docs, no_docs, library):
    got = [tuple(r) for r in sentencepiece_codec.query(docs).collect()]
    want = []
    for i, t in edge_rows():
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert order(got) == order(want)
    assert sentencepiece_codec.query(no_docs).count() == 0


def test_encode_and_decode_by_themselves(spark, docs):
    coded = sentencepiece_codec.encode(docs)
    texts = sorted(((r.doc_id, r.text) for r in sentencepiece_codec.decode(coded).collect()), key=str)
    assert texts == sorted(((i, t or "") for i, t in edge_rows()), key=str)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1, 2])], "doc_id long, ids array<int>")
    assert {r.text for r in sentencepiece_codec.decode(odd).collect()} == {""}


# --- 12 ----------------------------------------------------------------------------


def brute_search(rows, items, keep):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    docs = [(LAST if i is None else i, words(t)) for i, t in rows]
    n_docs, n_terms = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    df, out = Counter(t for _, w in docs for t in set(w)), []
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(words(t))
    counts = [(i, len(w), Counter(w)) for i, w in docs if w]
    for item, terms in of.items():
        found = []
        for i, n, tf in counts:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m))
                        for t in terms if tf[t])
            if score > 0:
                found.append((-score, i))
        out += [(item, r, None if i == LAST else i, -s) for r, (s, i) in enumerate(sorted(found)[:keep], 1)]
    return out


def item_rows(rows):
    rng = random.Random(5)
    full = [t for _, t in rows if t and len(t) < 5000]
    items = [(k, " ".join(rng.choice(full).split()[:12])) for k in range(25)]
    return items + [(30, None), (31, ""), (32, "zzznever"), (33, "one TWO one"), (None, "logged OFFICE"), (34, "日本語のテキスト ß İ 12"),
                    (3, "changed"), (33, "one two one"), (35, "a" * 5000), (36, " ".join(t for t in full))]


@pytest.mark.parametrize("keep,limits", [(50, None), (3, None), (5, (100_000, 12))])
def test_search(spark, docs, monkeypatch, keep, limits):
    rows = edge_rows()
    items = item_rows(rows)
    if limits:                                   # many blocks of few items
        monkeypatch.setattr(lexical_scan, "BLOCK_BYTES", limits[0])
        monkeypatch.setattr(lexical_scan, "BLOCK_ITEMS", limits[1])
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("id", "score", "rank", "n")})
    got = [tuple(r) for r in lexical_scan.search(docs, table, keep).collect()]
    assert order(got) == order(brute_search(rows, items, keep))


def test_best_rows_are_cut_in_many_steps():
    rng = np.random.default_rng(6)
    best, all_scores = lexical_scan._Best(3, 4), rng.integers(0, 6, (500, 3))
    for a in range(0, 500, 7):
        best.add(np.arange(a, min(a + 7, 500)), all_scores[a:a + 7])
    best.cut()
    got = list(zip(*(x.tolist() for x in best.rows)))
    want = [(i, d, s) for i in range(3) for s, d in sorted(((int(all_scores[d, i]), d) for d in range(500)), key=lambda x: (-x[0], x[1]))[:4]]
    assert got == want


def test_search_of_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical_scan.search(no_docs, items).count() == 0
    assert lexical_scan.search(docs, items.limit(0)).count() == 0
    assert lexical_scan.search(docs, spark.createDataFrame([(1, "--")], "item_id long, text string")).count() == 0


# --- 13 ----------------------------------------------------------------------------


def brute_resample(rows, target, percent=10, min_words=20, buckets=10_000, run=1, seed=2024):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    codes = lambda w: [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]
    docs = [(i, words(t)) for i, t in rows]
    s, t = Counter(c for _, w in docs for c in codes(w)), Counter(c for x in target for c in codes(words(x)))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for i, w in docs:
        c = codes(w)
        weight = sum(gain[x] for x in c) // max(len(c), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(c), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], LAST if r[0] is None else r[0]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def copies(rows):
    """A third of all rows repeat one row, and as many have no id."""
    text = next(t for i, t in rows if i == 16)
    return rows + [(16, text[:2000])] * 40 + [(None, text[:2000])] * 40


def same_draw(got, want):
    """Ranks of rows that are equal otherwise can stand in any order."""
    strip = lambda rows: sorted(str((r[0], r[1], r[2], r[3], r[4] is not None)) for r in rows)
    assert strip(got) == strip(want)
    place = lambda rows: [r[:4] for r in sorted((r for r in rows if r[4]), key=lambda r: r[4])]
    assert place(got) == place(want)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 1 + sum(1 for r in got if r[4])))


@pytest.mark.parametrize("percent,run,buckets,min_words", [(10, 1, 10_000, 20), (50, 2, 997, 1), (100, 1, 100_000, 0), (0, 1, 10_000, 20)])
def test_resample(spark, percent, run, buckets, min_words):
    rows = copies(edge_rows())
    target = [t for i, t in edge_rows() if i in (1, 3, 11, 15)] + [None, ""]
    docs = documents(spark, rows, clash=True)
    items = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in importance_resampling.resample(docs, items, percent, min_words, buckets, run).collect()]
    same_draw(got, brute_resample(rows, target, percent, min_words, buckets, run))


def test_cutoff_in_a_narrow_bracket(spark, monkeypatch):
    """Sketches that miss the cutoff are widened until exact counts hold it."""
    monkeypatch.setattr(importance_resampling, "SKETCH", 10)
    monkeypatch.setattr(importance_resampling, "WIDTH", 1e-6)
    rng = random.Random(7)
    rows = [(rng.randrange(30) if i % 3 else 5, i // 2, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "score long, id long, row long").repartition(7)
    best = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for draw in (1, 2, 299, 1500, 2999, 3000):
        assert importance_resampling.cutoff(df, 3000, draw) == best[draw - 1]


def test_resample_of_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert importance_resampling.resample(no_docs, items).count() == 0
    rows = edge_rows()
    got = [tuple(r) for r in importance_resampling.resample(docs, items.limit(0)).collect()]
    same_draw(got, brute_resample(rows, []))


def test_whole_queries_match_their_sql(spark):
    import duckdb
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    for df, sql in ((lexical_scan.search(docs, items), lexical_scan.ORACLE_SQL),
                    (importance_resampling.resample(docs, items), importance_resampling.ORACLE_SQL)):
        want = con.execute(sql)
        names = [x[0] for x in want.description]
        assert order(tuple(r) for r in df.select(*names).collect()) == order(want.fetchall())


def test_words_of_a_short_text_are_counted():
    data = np.frombuffer(b"ab c-d" + b"" + b"x" + b" y ", np.uint8)
    assert lexical_scan._numbers_of_terms(data, np.array([0, 6, 6, 7, 10])).tolist() == [3, 0, 1, 1]
    assert lexical_scan.terms_of("A-b ÄB c") == ["a", "b", "Äb", "c"]
    assert prose(random.Random(1), 3)
