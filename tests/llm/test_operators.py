"""Operators 5 to 10 and the pipeline: exact cases, brute force, round trips and
held-out accuracy."""

import html as html_lib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import CLASH, documents, edge_rows, prose
from wardlens.llm import html_extract, language_id, license_scan, mixing, nearest, packing

# --- 5 -----------------------------------------------------------------------------


def page(article, menu="Home", footer="About us", main=True):
    body = f"<article>{article}</article>" if main else f"<div>{article}</div>"
    return (f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><a href=/x>{menu}</a></nav><div class='ad'>Buy</div><!-- c -->{body}<div>{footer}</div></body></html>")


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", *[F.lit("x").alias(c) for c in ("id", "k", "host", "lines", "r", "_rank")])


def test_extract(spark):
    shared = "A quotation that two pages have."
    rows = [(1, "http://a.org/en/1", page(f"<h1>One</h1><p>First &amp; <b>bold</b>\n text<br><p>{shared}</p>")),
            (2, "http://a.org/en/2?x=1", page(f"<p>Second</p><p>{shared}</p>")),
            (3, "http://b.org/1", page("<p>Third</p>", main=False)),
            (4, "http://b.org/2", page("<p>Fourth</p>", menu="Other", main=False)),
            (5, "http://b.org/zzz", None), (6, None, ""), (7, "::bad[", "plain &lt; text"), (7, "::bad[", "plain &lt; text"),
            (None, "http://c.org/", page("<ul><li>a</li><li>b</li></ul><section class='comments'><p>nice</p></section>")),
            (8, "http://d.org/", "<p>" * 3000 + "deep" + "<p>x" * 2000)]
    got = {}
    for r in html_extract.extract(pages_of(spark, rows)).collect():
        got.setdefault(r.page_id, []).append(r)
    assert got[1][0].text == f"One\n\nFirst & bold text\n\n{shared}"
    assert got[2][0].text == f"Second\n\n{shared}"
    # without an article the footer goes because the neighbour has it
    assert got[3][0].text == "Third" and got[4][0].text == "Fourth"
    assert got[5][0].text == "" and got[6][0].text == "" and got[5][0].n_chars == 0
    assert [r.text for r in got[7]] == ["plain < text"] * 2
    assert got[None][0].text == "a\n\nb"
    assert got[8][0].text.startswith("deep\n\nx") and got[8][0].n_lines == 2001
    assert html_extract.extract(pages_of(spark, rows).limit(0)).count() == 0


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(2)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randrange(14))]
        b = [rng.randrange(5) for _ in range(rng.randrange(14))]
        at = html_extract.common_lines(np.array(a, np.int64), np.array(b, np.int64))
        assert len(at) == length(a, b) == length([a[i] for i in at], b)


def test_blocks_survive_broken_markup():
    for text in ("<", "<p", "a < b > c", "<p class='x>y", "</div></div>a", "<script>x", "<!-- a", "&#x110000; &bogus; &amp", "<svg><p>a</svg>b"):
        html_extract.blocks(text)
    assert html_extract.blocks("a &lt; b") == [("a < b", html_extract.ROLE_BODY)]
    assert html_lib.unescape("&lt;") == "<"

# --- 6 -----------------------------------------------------------------------------


@pytest.fixture
def mixed(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        domain = "toxic" if i % 8 == 0 else "low" if i % 8 == 1 else "clean"
        words = prose(rng, 80).split()
        if domain == "toxic":
            for w in ("scum", "moron", "trash"):
                words[rng.randrange(80)] = w
        if domain == "low":
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or i % 16 == 1:
            labels.append((i, int(domain != "low"), int(domain == "toxic")))
    rows += [(1000, None), (1001, ""), (None, "plain words"), (7, rows[7][1]), (1002, prose(rng, 30_000))]
    labels += [(None, 1, 1), (5000, None, 0), (2, 1, 0), (2, 1, 0)]
    return documents(spark, rows, clash=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mixing_matches_brute_force(mixed):
    docs, labels = mixed
    got = mixing.mixing_rates(docs, labels, weights={"clean": 0.7, "low": 0.25, "toxic": 0.05}, repeat=1.0).toPandas()
    assert len(got) == 404 and got.n_rows.sum() == 405
    p = got[["p_clean", "p_low", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1)
    for column, rest in ((2, 0), (1, 1)):
        own = p[got.id.lt(400) & (got.id % 8 == rest)][:, column]
        assert own.mean() > 0.9 and own.min() > 0.5
    tokens = (got.n_tokens * got.n_rows).to_numpy()[:, None] * p
    have = tokens.sum(axis=0)
    target = np.array([0.7, 0.25, 0.05]) * have[0] / 0.7
    r = np.ones(len(got))
    for _ in range(mixing.ROUNDS):
        before = r
        r = np.maximum(0, r - p @ ((r @ tokens - target) / have))
        if (np.abs(r @ tokens - before @ tokens) <= mixing.CLOSE * have).all():
            break
    assert np.allclose(r, got.rate, atol=1e-9)
    assert np.allclose(r @ tokens, target, rtol=0.02)
    assert ((got.copies == np.floor(got.rate)) | (got.copies == np.ceil(got.rate))).all()


def test_mix_keeps_columns_and_clean_documents(mixed):
    docs, labels = mixed
    out = mixing.mix(docs, labels, repeat=1.3, most=1.0)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert all(i in ids for i in range(400) if i % 8 > 1)
    assert not any(i in ids for i in range(0, 400, 8))
    assert len(ids) == len(set(ids)) + ids.count(7) - 1


def test_mixing_without_labels_or_documents(spark, mixed, no_docs):
    docs, labels = mixed
    alike = mixing.mixing_rates(docs, labels.limit(0)).select("p_clean", "p_low", "p_toxic").toPandas()
    assert np.allclose(alike, 1 / 3)
    assert mixing.mixing_rates(no_docs, labels).count() == 0
    assert mixing.mix(no_docs, labels).count() == 0

# --- 7 -----------------------------------------------------------------------------


LANGS = {"aa": ("ka", "lo", "mi", "ru"), "bb": ("sch", "ung", "keit", "ö"), "cc": ("eau", "oui", "ê", "tion")}


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def test_language_id(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(2, 60), LANGS[lang]), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 80)]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "cc"), (None, prose(rng, 20, LANGS["bb"]), "bb"), (903, prose(rng, 20, LANGS["aa"]), None),
           (904, "日本語" * 30, None), (905, prose(rng, 60_000, LANGS["cc"]), "cc"), (0, rows[0][1], "aa")]
    df = documents(spark, rows + odd, clash=True)
    got = language_id.language_id(df).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    right = [by[i].lang_pred == lang for i, _, lang in rows if held_out(i)]
    assert sum(right) >= 0.97 * len(right)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(by[i].rejected and by[i].score == 0 for i in (900, 901, 902))
    assert by[None].lang_pred == "bb" and by[903].lang_pred == "aa" and by[905].lang_pred == "cc"
    assert by[904].rejected and not any(by[i].rejected for i, _, _ in rows)
    # labels of held-out documents, source and id say nothing
    other = df.withColumn("lang", F.when(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), "zz").otherwise(F.col("lang")))
    assert sorted(map(str, language_id.language_id(other).collect())) == sorted(map(str, got))
    kept = language_id.keep_known(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got} - {900, 901, 902, 904}


FOREIGN = {
    "it": "Il governo ha annunciato ieri che le nuove misure entreranno in vigore all'inizio del prossimo anno. Molte persone si chiedono se il tempo basti",
    "pt": "O governo anunciou ontem que as novas medidas entrarão em vigor no início do próximo ano. Muitas pessoas perguntam se haverá tempo suficiente",
    "nl": "De regering heeft gisteren aangekondigd dat de nieuwe maatregelen begin volgend jaar van kracht worden. Veel mensen vragen zich af of dat lukt",
    "pl": "Rząd ogłosił wczoraj, że nowe środki wejdą w życie na początku przyszłego roku. Wielu ludzi pyta, czy wystarczy czasu",
    "ru": "Правительство объявило вчера, что новые меры вступят в силу в начале следующего года. Многие спрашивают, хватит ли времени",
    "zh": "政府昨天宣布新措施将于明年年初生效市民须在三月底前向所在城市的市政办公室提交申请",
    "ja": "政府は昨日新しい措置が来年の初めに発効し市民は三月末までに市役所に申請書を提出しなければならないと発表した"}


def test_unlearned_languages_are_rejected(spark):
    rng = random.Random(8)
    learned = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = [f"{text}. " * n for text in FOREIGN.values() for n in (1, 5)]
    odd += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (150, 3000)]
    df = learned.unionByName(spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language_id.language_id(df).collect()}
    assert all(got[10**9 + i].rejected for i in range(len(odd)))
    clean = [r for i, r in got.items() if i < 10**9 and r.held_out and r.lang_pred != "und"]
    assert sum(r.rejected for r in clean) <= 0.02 * len(clean)


def test_language_id_without_labels(spark, no_docs):
    df = documents(spark, [(1, "abc", None), (2, None, None)])
    assert {(r.lang_pred, r.score) for r in language_id.language_id(df).collect()} == {("und", 0.0)}
    assert language_id.language_id(no_docs).count() == 0
    assert language_id.keep_known(no_docs).count() == 0

# --- 8 -----------------------------------------------------------------------------


def test_license_scan(spark):
    full = "\n".join(s[0] for k, s in license_scan.SENTENCES.items() if k in ("mit.grant", "mit.notice", "asis.software"))
    wrapped = full.replace(" to ", "\nto ").replace(" the Software", "\n the   Software")
    rows = [(1, "Text.\nReleased under the MIT License.\nMore."), (2, full), (3, wrapped), (4, "Licensed under CC BY-NC 4.0. All rights reserved!"),
            (5, "The MIT License is mentioned here only."), (6, None), (7, ""), (None, "all RIGHTS reserved"), (8, "word " * 100_000 + ". All rights reserved."),
            (9, "\n".join(license_scan.SENTENCES[k][0] for k in ("bsd.grant", "bsd.source", "bsd.binary"))),
            (9, "\n".join(license_scan.SENTENCES[k][0] for k in ("bsd.grant", "bsd.source", "bsd.binary")))]
    got = [(r.doc_id, r.licenses) for r in license_scan.license_scan(documents(spark, rows, clash=True)).collect()]
    assert dict(got) == {1: ["MIT"], 2: ["MIT"], 3: ["MIT"], 4: ["CC-BY-NC-4.0", "all-rights-reserved"], 5: [], 6: [], 7: [],
                         None: ["all-rights-reserved"], 8: ["all-rights-reserved"], 9: ["BSD-2-Clause"]}
    assert len(got) == len(rows)


def test_rules_are_ordered():
    assert license_scan.match_rules(["asis.software", "mit.notice", "mit.grant"]) == [(2, "MIT", "permissive")]
    assert [m[1] for m in license_scan.match_rules(["bsd.grant", "reserved", "bsd.source", "bsd.binary", "bsd.endorse"])] == ["BSD-3-Clause", "all-rights-reserved"]


def test_common_licences_are_known():
    def scan(text):
        return [m[1] for m in license_scan.match_rules(license_scan.sentence_ids(text.encode())[1])]

    free = "is free software; you can redistribute it and/or modify it\nunder the terms of the GNU {} as published by\nthe Free Software Foundation; either version {} of the License, or (at your option) any later version."
    endorse = "Neither the name of the University of Somewhere nor the names of its contributors may be used\nto endorse or promote products derived from this software without specific prior written permission."
    bsd = "\n".join(license_scan.SENTENCES[k][0] for k in ("bsd.grant", "bsd.source", "bsd.binary"))
    assert scan(bsd + "\n" + endorse) == ["BSD-3-Clause"]
    assert scan("This program " + free.format("General Public License", 2).replace("software;", "software:")) == ["GPL-2.0-or-later"]
    assert scan("This library " + free.format("Lesser General Public License", 2.1)) == ["LGPL-2.1-or-later"]
    assert scan("Foo " + free.format("Affero General Public License", 3)) == ["AGPL-3.0-or-later"]
    assert scan("Licensed under CC BY-NC-SA 3.0.") == ["CC-BY-NC-SA-3.0"] and scan("Licensed under CC BY-ND 4.0.") == ["CC-BY-ND-4.0"]
    assert scan("Text.\nThis Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy") == ["MPL-2.0"]
    assert scan(license_scan.SENTENCES["isc.grant"][1]) == ["ISC"] and scan("This is free and unencumbered software released into the public domain.") == ["Unlicense"]
    assert scan(license_scan.SENTENCES["epl2.terms"][0]) == ["EPL-2.0"]
    assert scan("// SPDX-License-Identifier: (MIT OR GPL-2.0+) AND Apache-2.0 WITH LLVM-exception\nint x;") == ["MIT", "GPL-2.0-or-later", "Apache-2.0"] or \
        sorted(scan("// SPDX-License-Identifier: (MIT OR GPL-2.0+) AND Apache-2.0 WITH LLVM-exception\nint x;")) == ["Apache-2.0", "GPL-2.0-or-later", "MIT"]


def test_license_scan_of_an_empty_table(no_docs):
    assert license_scan.license_scan(no_docs).count() == 0

# --- 9 -----------------------------------------------------------------------------


def test_packing_is_an_exact_round_trip(docs):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(packing.default_tokenizer())
    tk.encode_special_tokens = True
    want = {}
    for i, t in edge_rows():
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        want.setdefault(i, []).append(ids)
    got = packing.pack_documents(docs, shard_bytes=200_000).collect()
    windows, tokens = {}, {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        tokens.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in windows.values():                      # gapless from 0, never over the window
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    for i, texts in want.items():
        pieces = sorted((s, n, c, d) for s, n, c, d in tokens[i])
        expect = []
        for ids in texts:
            cuts = sorted({(s, n) for s, n, _, d in pieces if d == len(ids)})
            expect += [(s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()), len(ids)) for s, n in cuts]
        assert set(expect) >= set(pieces)
        assert sum(n for _, n, _, _ in pieces) == sum(map(len, texts))
    total = sum(r.length for r in got)
    shards = len({r.sequence_id >> 32 for r in got})
    assert len(windows) <= math.ceil(total / packing.WINDOW) + shards


def test_packing_deals_neighbours_to_one_shard(spark):
    rng = random.Random(12)
    common = prose(rng, 60).split()
    rows = []
    for i in range(200):                                # two documents a topic
        topic = ["".join(rng.choice("bcdfgjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(3)) for _ in range(30)]
        rows += [(2 * i + j, " ".join(rng.choice(topic if rng.random() < 0.7 else common) for _ in range(200))) for j in (0, 1)]
    size = sum(len(t) for _, t in rows) // 20
    got = packing.pack_documents(documents(spark, rows), shard_bytes=size).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.doc_id, set()).add(r.sequence_id >> 32)
    assert len(set().union(*shards.values())) >= 20
    assert sum(bool(shards[2 * i] & shards[2 * i + 1]) for i in range(200)) >= 60         # a hash of ids: about 10
    copies = documents(spark, [(i, rows[0][1]) for i in range(400)])      # a hot key is salted
    per = {}
    for r in packing.pack_documents(copies, shard_bytes=size).collect():
        per.setdefault(r.sequence_id >> 32, set()).add(r.doc_id)
    assert len(per) > 10 and max(map(len, per.values())) < 60


def test_words_have_the_tokenizers_ids():
    tk = packing.tokenizer(packing.default_tokenizer())
    texts = ["", "  a  b ", "Hello's WORLD!! 12 ½ don't", "日本", "x\x1cy", "İstanbul ÀÉß", "a_b __ c'd ''s 're", "<|endoftext|> x", "tab\tnl\n\x0b\x0c"]
    for t, ids in zip(texts, tk.ids(texts)):
        assert ids.tolist() == [*tk.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID]


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * t, 1000 * t + 300, (6, 200)).astype("<u4") for t in range(4)]
    docs = [topics[i % 4][i // 4] for i in range(24)]
    pieces = packing.pack(docs, window=600)
    first = {}
    for i, _, _, seq, at in pieces:
        first.setdefault(seq, []).append(i % 4)
    assert sum(len(set(t)) == 1 for t in first.values()) >= 6


def test_packing_of_an_empty_table(no_docs):
    assert packing.pack_documents(no_docs).count() == 0

# --- 10 ----------------------------------------------------------------------------


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


def brute_nearest(rows, k=20, every=20):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i, tuple(np.float32(x) for x in v)] = np.array(v, np.float32).astype(float)
    out = {}
    for (q, _), x in ok.items():
        if q % every == 0:
            found = sorted((-float((x * y).sum()), i) for (i, _), y in ok.items() if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_nearest(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=24) * rng.uniform(0.2, 3)]) for i in range(900)]
    same = rows[40][1]
    rows += [(2000 + i, same) for i in range(120)]                  # ties
    rows += [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] + [1.0] * 23), (5080, [float("inf")] * 24), (5100, []),
             (None, same), rows[0], (6000, [1.0, 2.0]), (6001, [2.0, 1.0])]
    got = {}
    for r in nearest.nearest(vectors(spark, rows), block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows)
    assert set(got) == {q for q, w in want.items() if w}
    hit = total = 0
    for q, w in want.items():
        if not w:
            continue
        assert [r for r, _, _ in got[q]] == list(range(1, len(w) + 1))
        scores = dict(w)
        hit += len({v for _, v, _ in got[q]} & set(scores))
        total += len(w)
        assert sorted(got[q], key=lambda x: (-x[2], x[1])) == got[q]
        assert all(math.isclose(s, scores[v], rel_tol=1e-12) for _, v, s in got[q] if v in scores)
    assert hit >= 0.9 * total
    assert got[6000] == [(1, 6001, 4.0)]


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(8)
    rows = [(i * 20, [float(x) for x in rng.normal(size=64)]) for i in range(12)]
    got = nearest.nearest(vectors(spark, rows)).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {11} and len(got) == 12
    assert nearest.nearest(vectors(spark, rows[:1])).count() == 0
    assert nearest.nearest(vectors(spark, rows).limit(0)).count() == 0


def test_perturbations_come_in_order_of_distance():
    edge = np.array([0.1, 0.6, 0.3, 0.9, 0.4, 0.7])
    steps = nearest.perturbations(edge, 20)
    cost = [sum(edge[j if s < 0 else 3 + j] ** 2 for j, s in enumerate(row) if s) for row in steps]
    assert cost == sorted(cost) and len({tuple(r) for r in steps}) == len(steps) == 20

# --- pipeline ----------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(1)
    rows = edge_rows() + [(3000 + i, prose(rng, 50)) for i in range(60)]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3000 + i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            path = str(tmp_path / name)
            out.write.parquet(path)
            now = spark.read.parquet(path)
    left = {r.doc_id for r in now.collect()}
    assert {3000 + i for i in range(60)} <= left and not {2, 3, 4, 5, 6, 7, 8, 18} & left and 1 in left
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(left)


def test_packing_gives_the_words_back_after_tokenizing(spark):
    def held(batches):
        packing.tokenizer(packing.default_tokenizer()).ids(["some words to keep"])
        packing.forget()
        for b in batches:
            yield b.from_pydict({"n": [len(packing._TOKENIZERS)]})

    assert {r.n for r in spark.range(4).mapInArrow(held, "n long").collect()} == {0}


def test_a_part_of_a_word_met_before_is_not_tokenized_again():
    tk = packing.WordTokenizer(packing.default_tokenizer())
    model, seen = tk.model, []

    class Counted:
        def tokenize(self, part):
            seen.append(part)
            return model.tokenize(part)

    tk.model = Counted()
    tk.ids(["neighbour , ."])
    got = tk.ids(["neighbour, Neighbour. (neighbour)"])[0]
    assert seen == ["neighbour", ",", ".", "(", ")"]
    assert got.tolist() == [*tk.tokenizer.encode("neighbour, neighbour. (neighbour)", add_special_tokens=False).ids, packing.END_ID]
    letters = [chr(c) for c in range(0x250) if not tk.OTHER.search(chr(c)) and chr(c).isalpha()]
    assert all(tk.PART.findall(c + c) == [c + c] for c in letters)       # a word of letters is one part
