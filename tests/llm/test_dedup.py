"""Operators 1 to 4 against brute force on fixtures with every awkward case."""

import hashlib
import re
from collections import defaultdict

import pytest

from llm_fixtures import documents, edge_rows  # noqa: I001
from wardlens.llm import exact_dedup, jaccard_join, line_dedup, suffix_dedup

LAST = (1 << 63) - 1


def key(i):
    return LAST if i is None else i


def brute_suffix(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(first.get(s, LAST + 1), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < key(i):
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("hot,bucket,many", [(10_000, 64 << 20, 64), (2, 1 << 16, 1)])
def test_suffix_dedup(docs, hot, bucket, many):
    rows = [r for r in edge_rows()]
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(docs, hot, bucket, many).collect()]
    assert order(got) == order(brute_suffix(rows))


def test_suffix_order_is_lexicographic():
    import numpy as np
    data = np.frombuffer(b"banana" * 30, np.uint8)
    at = np.arange(len(data) - suffix_dedup.LENGTH + 1)
    order_, new = suffix_dedup.suffix_order(np.zeros(len(at), np.int64), at, data, at)
    strings = [bytes(data[i:i + suffix_dedup.LENGTH]) for i in order_]
    assert strings == sorted(strings)
    assert new.sum() == len(set(strings))


def brute_exact(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), key(i), n))
    out = []
    for text, members in groups.items():
        best = min(members)
        for m in members:
            i = rows[m[2]][0]
            out.append((i, None if best[1] == LAST else best[1], len(members), hashlib.sha256(text.encode()).hexdigest(), -m[0]))
    return out


@pytest.mark.parametrize("moduli,parallel", [(exact_dedup.MODULI, exact_dedup.PARALLEL_BYTES), ((3, 2), 1000), (exact_dedup.MODULI, 1000)])
def test_exact_dedup(docs, moduli, parallel):
    """Also with colliding fingerprints, and with pieces hashed apart."""
    rows = edge_rows()
    got = exact_dedup.exact_dedup(docs, moduli, parallel).collect()
    assert order([(r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.n_chars) for r in got]) == order(brute_exact(rows))
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_fingerprints_compose():
    data = bytes(range(256)) * 700
    whole = exact_dedup.fingerprint(data, 0)
    a, b = exact_dedup.fingerprint(data[:99_999], 0), exact_dedup.fingerprint(data[99_999:], 99_999)
    assert whole == [(x + y) % p for x, y, p in zip(a, b, exact_dedup.MODULI)]


def shingles(t, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_jaccard(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    small = defaultdict(lambda: LAST)
    for n, (i, _) in enumerate(rows):
        small[find(n)] = min(small[find(n)], key(i))
    return [(i, len(sets[n]), None if small[find(n)] == LAST else small[find(n)]) for n, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard_join(spark, block):
    """Chains of near copies, so that links and not one centre make the groups."""
    import random
    rng = random.Random(5)
    rows = edge_rows()
    for chain in range(4):
        words = [f"w{chain}x{i}" for i in range(80)]
        for step in range(12):
            rows.append((1000 * (chain + 1) + step, " ".join(words)))
            words = list(words)
            words[rng.randrange(80)] = f"new{chain}x{step}"
    df = documents(spark, rows, clash=True)
    got = [tuple(r) for r in jaccard_join.jaccard_join(df, block=block).collect()]
    assert order(got) == order(brute_jaccard(rows))


@pytest.mark.parametrize("block", [8])
def test_pairs_that_only_seem_to_link_hide_no_link(spark, block):
    """Long texts, whose coarse bounds let many pairs pass that do not link, around the
    threshold on both sides; the centre of each family is not among them."""
    import random
    rng = random.Random(8)
    rows = []
    for family, n in enumerate((2600, 2600, 300)):
        base = [f"f{family}w{i}" for i in range(n)]
        for k in range(16):
            size, at = int(n * rng.uniform(0.04, 0.12)), rng.randrange(n)
            words = [f"f{family}k{k}n{i}" if (i - at) % n < size else w for i, w in enumerate(base)]
            rows.append((100 * family + k, " ".join(words)))
    rng.shuffle(rows)
    got = [tuple(r) for r in jaccard_join.jaccard_join(documents(spark, rows), block=block).collect()]
    want = brute_jaccard(rows)
    assert order(got) == order(want) and len({c for _, _, c in want}) > 3


def test_torn_blocks_are_met_once(spark, monkeypatch):
    """Two long texts that only seem to link share hundreds of rare shingles: of the blocks with
    the same texts one is looked at."""
    import random
    rng = random.Random(3)
    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(2600)]
        for k in range(6):
            at = rng.randrange(2600)
            rows.append((100 * family + k, " ".join(f"f{family}k{k}n{i}" if (i - at) % 2600 < 190 else w for i, w in enumerate(base))))
    kept, real = [], jaccard_join.store

    def watched(df, name):
        out = real(df, name)
        if name == "op4-torn":
            kept.append(out)
        return out

    monkeypatch.setattr(jaccard_join, "store", watched)
    got = [tuple(r) for r in jaccard_join.jaccard_join(documents(spark, rows)).collect()]
    assert order(got) == order(brute_jaccard(rows))
    blocks = defaultdict(set)
    for r in kept[0].collect():
        blocks[r.h].add(r.sid)
    assert blocks and len({frozenset(b) for b in blocks.values()}) == len(blocks)


def test_pairs_grow_with_the_group(spark, monkeypatch):
    """A group without a centre: each copy has changes of its own.  Three times the copies
    make about three times the pairs, not nine times."""
    import random
    made = []
    real = jaccard_join.store

    def counted(df, name):
        out = real(df, name)
        if name in ("op4-pairs", "op4-likely"):
            made[-1] += out.count()
        return out

    monkeypatch.setattr(jaccard_join, "store", counted)
    for copies in (100, 300):
        rng = random.Random(9)
        base, rows = [f"w{i}" for i in range(200)], []
        for k in range(copies):
            words = list(base)
            for i in rng.sample(range(200), 4):
                words[i] = f"k{k}n{i}"
            rows.append((k, " ".join(words)))
        made.append(0)
        got = jaccard_join.jaccard_join(documents(spark, rows), block=64).collect()
        assert order(tuple(r) for r in got) == order(brute_jaccard(rows))
    assert made[1] < 5 * made[0] and made[1] < 8 * 300


def test_keep_one(spark):
    rows = edge_rows()
    want = defaultdict(set)
    for (i, n, c) in brute_jaccard(rows):
        want[c if n else ("empty", key(i))].add(i)
    kept = [r.doc_id for r in jaccard_join.keep_one(documents(spark, rows, clash=True)).collect()]
    assert len(kept) == len(want)
    assert all(any(k in members for k in kept) for members in want.values())


def test_point_bound_is_never_below_the_overlap():
    import numpy as np
    rng = np.random.default_rng(1)
    for n in [100, 300, 2040, 2048, 2049, 5000] * 4:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        b = np.unique(np.concatenate([a[:n * 2 // 3], rng.integers(0, 1 << 63, n // 2).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        p, q = jaccard_join.point(a), jaccard_join.point(b)
        assert np.minimum(jaccard_join.narrow(p), jaccard_join.narrow(q)).sum(dtype=np.int64) >= both
        assert jaccard_join.minima(jaccard_join.fine_point(a), jaccard_join.fine_point(b)) >= both
        large = tuple(len(x) > jaccard_join.FINE for x in (a, b))
        assert jaccard_join.overlap_bound(*(x if w else jaccard_join.fine_point(y) for x, w, y in zip((p, q), large, (a, b))), large) >= both


def test_overlaps_are_the_bounds_of_the_fine_points():
    import numpy as np
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64) << np.uint64(1))
    sets = [np.sort(rng.choice(base, n, replace=False)) for n in (1, 40, 300, 300, 1500, 2048, 2049, 5000)]
    sets.append(base[:200])                                  # many of one group
    sets.append(np.concatenate([base[:150], base[-90:]]))
    wide = [len(s) > jaccard_join.FINE for s in sets]
    finer = [jaccard_join.point(s) if w else jaccard_join.fine_point(s) for s, w in zip(sets, wide)]
    finer += [np.repeat(np.uint16(7), 30), np.repeat(np.array([7, 9], np.uint16), 12)]
    wide += [False, False]
    table = np.zeros(1 << 16, np.uint16)
    overlaps = jaccard_join.Overlaps(finer, wide, table)
    for u in range(len(finer)):
        for v in range(len(finer)):
            assert overlaps.bound(u, v) == jaccard_join.overlap_bound(finer[u], finer[v], (wide[u], wide[v]))
    overlaps.clear()
    assert not table.any()
    points = jaccard_join.block_points(finer, np.array(wide))
    for p, f, w in zip(points, finer, wide):
        assert (p == (jaccard_join.narrow(f) if w else np.bincount(f >> 8, minlength=jaccard_join.DIMS))).all()


def brute_lines(rows, depth=3, min_docs=10, similarity=0.8):
    seen = {}
    lines = []
    for i, t in rows:
        if (i, t) in seen:
            continue
        seen[i, t] = True
        for pos, line in enumerate((t or "").split("\n")):
            masked = tuple("<*>" if re.search("[0-9]", w) else w for w in re.split("[ \t\x0b\f\r]+", line) if w)
            if masked:
                lines.append((key(i), t, pos, (len(masked), masked[:depth]), masked))
    docs_of = defaultdict(set)
    for i, _, _, leaf, _ in lines:
        docs_of[leaf].add(i)
    lines = [x for x in lines if len(docs_of[x[3]]) >= min_docs]
    count = defaultdict(int)
    for _, _, _, leaf, masked in lines:
        for at, w in enumerate(masked):
            count[leaf, at, w] += 1
    found = defaultdict(list)
    for i, t, pos, leaf, masked in lines:
        fixed = tuple(w if w != "<*>" and count[leaf, at, w] >= min_docs else "<*>" for at, w in enumerate(masked))
        if sum(w != "<*>" for w in fixed) >= similarity * len(fixed):
            found[leaf, fixed].append((i, t, pos))
    drop = set()
    for places in found.values():
        if len({i for i, _, _ in places}) >= min_docs:
            drop |= set(places) - {min(places, key=lambda p: (p[0], p[2]))}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for pos, x in enumerate(parts) if (key(i), t, pos) not in drop]
        out.append((i, "\n".join(kept), 0 if t is None else len(parts), len(parts) - len(kept)))
    return out


def test_line_dedup(docs):
    rows = edge_rows()
    got = [(r.doc_id, r.text or "", r.lines_total, r.lines_dropped) for r in line_dedup.line_dedup(docs).collect()]
    want = brute_lines(rows)
    assert sum(w[3] for w in want) == 26            # 13 of "user <*> ..." and 13 notices
    assert order(got) == order(want)


def test_line_dedup_keeps_columns(docs):
    out = line_dedup.without_recurring(docs)
    assert out.columns == docs.columns
    assert {r._id for r in out.select("_id").collect()} == {"x _id"}
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())


def test_empty_tables(no_docs):
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert jaccard_join.jaccard_join(no_docs).count() == 0
    assert line_dedup.line_dedup(no_docs).count() == 0
    assert jaccard_join.keep_one(no_docs).count() == 0
