"""Lexical retrieval packing (operator 9).

Documents are dealt to shards of at most about ``SHARD_BYTES`` of text by content; the
number of shards follows the corpus.  A document's key is the token of smallest rank, ranks
being drawn so that rare tokens come first more often (min-hash weighted by rarity), and
documents of one key share a shard.  A key with more text than a shard holds is divided by
a second such key, and what is still too much (copies) by a hash.  Neighbours with other
keys can be in other shards.  A shard holds a BM25 inverted index of its documents.  Long
documents give whole windows first.  Then the unused document of smallest id seeds a
window, its unused BM25 neighbours fill it in score order, and the neighbour that does
not fit is cut; its rest seeds the next window.  So only the last window of a shard can
be short.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_doc_id, doc_rows, record, slices, small_batches, store, text_key

WINDOW = 2048
END_ID = 1                     # closes each document
SHARD_BYTES = 3 << 20
K1, B = 1.2, 0.75
RARITY = 8                     # power of a token's log rarity in its weight as a key
SUBS = 16                      # second keys for each shard that a large key fills
CACHE_WORDS = 600_000          # words whose ids a worker keeps
TOKENIZE_BYTES = 4 << 20       # text tokenized at a time: a word is looked up once in it

PIECE = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
TOKENS = pa.schema([("id", pa.int64()), ("tkey", pa.int64()), ("size", pa.int64()), ("tokens", pa.binary())])
DEALT = pa.schema([("id", pa.int64()), ("tkey", pa.int64()), ("tokens", pa.binary()), ("shard", pa.int64())])
CELL = pa.schema([("cell", pa.int64()), ("n", pa.int64())])
PIECE_DDL = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes
    for themselves, the others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts.  Texts of plain Latin letters are cut at white space, where the
    vocabulary always ends a token, and the ids of each word are looked up; any other
    text goes to the tokenizer as it is.  Both ways give the tokenizer's ids."""

    # the vocabulary's word pattern, for the characters that OTHER leaves
    PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    OTHER = re.compile("[^\t-\r -~À-įı-ɏ]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True       # their names in a text are text
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}                 # of late
        self.older: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _word(self, word: str) -> bytes:
        known = self.older.get(word)
        if known is None:
            if word.isalpha():                            # one part
                known = self._part(word)
            else:                                         # its parts can be words met before
                known = b"".join([self.words.get(p) or self.older.get(p) or self._part(p) for p in self.PART.findall(word)])
        self.words[word] = known
        return known

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, the closing one included."""
        if len(self.words) > CACHE_WORDS:                 # words not met of late are forgotten
            self.words, self.older = {}, self.words
        other = [bool(self.OTHER.search(t)) for t in texts]
        plain = pa.array(["" if o else t for t, o in zip(texts, other)], pa.large_string())
        split = pc.utf8_split_whitespace(pc.utf8_lower(plain))
        coded = split.values.dictionary_encode()
        find = self.words.get
        raw = [find(w) or self._word(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        raw.append(np.array([END_ID], "<u4").tobytes())
        flat = np.frombuffer(b"".join(raw), "<u4")
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        starts = np.cumsum(sizes) - sizes
        # the closing id goes after the last word of each text
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        word = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(raw) - 1)
        n = sizes[word]
        upto = np.cumsum(n)
        out = flat[np.repeat(starts[word] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        at = [0, *upto[ends + np.arange(len(ends))].tolist()]
        return [np.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4"), np.uint32(END_ID)).astype("<u4")
                if o else out[lo:hi] for t, o, lo, hi in zip(texts, other, at, at[1:])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def forget() -> None:
    """Gives back the words that a worker keeps: workers serve later stages, which read
    stored ids only."""
    if _TOKENIZERS:
        _TOKENIZERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


class Bm25:
    """Inverted index of a shard: for each term the documents and their BM25 weights.
    Terms of more than half of the documents weigh nothing and are left out, as the
    formula has it."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        lengths = np.array([len(d) for d in docs])
        width = int(max((int(d.max()) for d in docs if len(d)), default=0)) + 1
        keys = np.concatenate([d.astype(np.int64) + i * width for i, d in enumerate(docs)]) if n else np.zeros(0, np.int64)
        keys, tf = np.unique(keys, return_counts=True)
        doc, term = keys // width, keys % width
        df = np.bincount(term, minlength=width)
        idf = np.log(np.maximum((n - df + 0.5) / (df + 0.5), 1.0))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(lengths.mean() if n else 1, 1)))
        keep = weight > 0
        doc, term, weight = doc[keep], term[keep], weight[keep]
        self.n, self.of_doc = n, np.searchsorted(doc, np.arange(n + 1))
        self.doc_terms = term
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(width + 1))

    def scores(self, i: int) -> np.ndarray:
        terms = self.doc_terms[self.of_doc[i]:self.of_doc[i + 1]]
        lo, n = self.at[terms], self.at[terms + 1] - self.at[terms]
        total = int(n.sum())
        if not total:
            return np.zeros(self.n)
        take = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        return np.bincount(self.doc[take], self.weight[take], minlength=self.n)


def pack(docs: list[np.ndarray], window: int = WINDOW):
    """(document, start, length, sequence, offset) of every piece of one shard."""
    out, seq, start = [], 0, [0] * len(docs)
    for i, d in enumerate(docs):                       # whole windows of long documents
        while len(d) - start[i] >= window:
            out.append((i, start[i], window, seq, 0))
            start[i] += window
            seq += 1
    pool = [i for i, d in enumerate(docs) if len(d) > start[i]]
    index = Bm25([docs[i][start[i]:] for i in pool])
    free = np.ones(len(pool), bool)
    rest = None
    for first in range(len(pool)):
        while rest is not None or free[first]:
            seed, rest = (first if rest is None else rest), None
            free[seed] = False
            i = pool[seed]
            used = len(docs[i]) - start[i]
            out.append((i, start[i], used, seq, 0))
            if used < window and free.any():
                candidates = np.flatnonzero(free)
                ranked = candidates[np.argsort(-index.scores(seed)[candidates], kind="stable")]
                for c in ranked.tolist():
                    i = pool[c]
                    take = min(len(docs[i]) - start[i], window - used)
                    out.append((i, start[i], take, seq, used))
                    free[c] = False
                    start[i] += take
                    used += take
                    if used == window:
                        rest = c if len(docs[i]) > start[i] else None
                        break
            seq += 1
    return out


def _packed(path: str) -> str:
    """Type of the stored ids."""
    return "<u2" if tokenizer(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _tokens(batch: pa.RecordBatch, kind: str):
    """(ids of the batch's documents end to end, where each begins)."""
    raw = batch.column(batch.schema.names.index("tokens")).to_pylist()
    sizes = np.array([len(r) for r in raw]) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(raw), kind), np.cumsum(sizes) - sizes


def _totals(rows: DataFrame, cells) -> dict[int, int]:
    """Sums of ``cells(batch)``, (cell, n) arrays, over all batches."""
    def run(batches):
        forget()
        for b in batches:
            if len(b):
                at, n = cells(b)
                key, place = np.unique(at, return_inverse=True)
                yield record(CELL, key.astype(np.int64), np.bincount(place, n).astype(np.int64))

    return {r["cell"]: r["n"] for r in rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}


def ranks(seen: np.ndarray, seed: int) -> np.ndarray:
    """Order of the tokens as keys; those met once (no one shares them) come last."""
    weight = np.where(seen > 1, np.log1p(seen.sum() / np.maximum(seen, 1)) ** RARITY, 1e-9)
    drawn = -np.log(1 - np.random.default_rng(seed).random(len(seen))) / weight
    out = np.empty(len(seen), np.int64)
    out[np.argsort(drawn, kind="stable")] = np.arange(len(seen))
    return out


def _plan(sizes: list[tuple[int, int]], shard_bytes: int) -> dict[int, tuple[int, int]]:
    """(first shard, number of shards) of each cell, in the order given."""
    out, shard, held = {}, 0, 0
    for cell, n in sizes:
        if held and held + n > shard_bytes:
            shard, held = shard + 1, 0
        parts = max(1, -(-n // shard_bytes))
        out[cell] = shard, parts
        shard, held = (shard, held + n) if parts == 1 else (shard + parts, 0)
    return out


def deal(rows: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, tkey, tokens, shard) of rows (id, text)."""
    small_batches(rows.sparkSession)
    kind, vocabulary = _packed(path), tokenizer(path).tokenizer.get_vocab_size()

    def tokenize(batches):
        own = tokenizer(path)
        for b in batches:
            for lo, hi in slices(b.column("size").to_numpy(), TOKENIZE_BYTES):
                part = b.slice(lo, hi - lo)
                tokens = own.ids(part.column("text").to_pylist())
                yield record(TOKENS, part.column("id"), part.column("tkey"), part.column("size"), [t.astype(kind).tobytes() for t in tokens])

    sized = rows.select("id", text_key().alias("tkey"), F.octet_length("text").cast("long").alias("size"), "text")
    taken = store(sized.mapInArrow(tokenize, "id long, tkey long, size long, tokens binary"), "op9-tokens")

    def terms(batch):
        seen = np.bincount(_tokens(batch, kind)[0], minlength=vocabulary)
        at = np.flatnonzero(seen)
        return at, seen[at]

    seen = np.zeros(vocabulary)
    for term, n in _totals(taken.select("tokens"), terms).items():
        seen[term] = n
    first, second = ranks(seen, 1), ranks(seen, 2)
    shared = rows.sparkSession.sparkContext.broadcast((first, second))

    def keys(batch):
        flat, starts = _tokens(batch, kind)
        return [np.minimum.reduceat(r[flat], starts) for r in shared.value]

    def size_of(batch):
        return batch.column(batch.schema.names.index("size")).to_numpy()

    sizes = _totals(taken.select("size", "tokens"), lambda b: (keys(b)[0], size_of(b)))
    subs = np.ones(vocabulary, np.int64)              # second keys of each first key
    for key, n in sizes.items():
        if n > shard_bytes:
            subs[key] = SUBS * -(-n // shard_bytes)
    base = np.cumsum(subs) - subs

    def cells(batch):
        one, two = keys(batch)
        return base[one] + (two * 0x9E3779B1 >> 7) % subs[one]

    if (subs > 1).any():
        sizes = _totals(taken.select("size", "tokens"), lambda b: (cells(b), size_of(b)))
    else:
        sizes = {int(base[key]): n for key, n in sizes.items()}
    planned = _plan(sorted(sizes.items()), shard_bytes)
    known = np.array(sorted(planned), np.int64)
    plan = rows.sparkSession.sparkContext.broadcast((known, np.array([planned[c] for c in known.tolist()], np.int64).reshape(-1, 2)))

    def dealt(batches):
        forget()
        known, places = plan.value
        for b in batches:
            if len(b):
                at = places[np.searchsorted(known, cells(b))]
                ids, tkeys = (b.column(b.schema.names.index(c)).to_numpy() for c in ("id", "tkey"))
                salt = (ids * 0x9E3779B1 ^ tkeys) >> 17
                yield record(DEALT, b.column("id"), b.column("tkey"), b.column(b.schema.names.index("tokens")), at[:, 0] + salt % at[:, 1])

    return taken.mapInArrow(dealt, "id long, tkey long, tokens binary, shard long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has only the closing id.  Repeated rows are packed each for
    itself; ties in score go to the smaller doc_id, then the smaller text key; an empty
    table gives an empty result.  A shard is a task's group: at most about ``shard_bytes`` of
    text, or one longer document."""
    path = tokenizer_path or default_tokenizer()
    kind = _packed(path)
    keyed = deal(doc_rows(docs), path, shard_bytes)

    def run(group: pa.Table) -> pa.Table:
        forget()
        shard = group.column("shard")[0].as_py()
        group = group.sort_by([("id", "ascending"), ("tkey", "ascending")])
        tokens = [np.frombuffer(t, kind).astype("<u4") for t in group.column("tokens").to_pylist()]
        ids = group.column("id").to_pylist()
        rows = [(ids[i], s, n, zlib.crc32(np.ascontiguousarray(tokens[i][s:s + n])), len(tokens[i]), (shard << 32) + seq, at)
                for i, s, n, seq, at in pack(tokens, window)]
        return pa.Table.from_batches([record(PIECE, *([r[j] for r in rows] for j in range(7)))])

    return keyed.groupBy("shard").applyInArrow(run, PIECE_DDL).select(as_doc_id().alias("doc_id"), "start", "length", "ids_crc32",
                                                                     "doc_tokens", "sequence_id", "offset")
