"""SentencePiece encoding and decoding (operator 11).

Encoding is exact for merge-type models and never runs the merge loop over a text.  A
text is cut where no piece of the vocabulary can reach across; each part is encoded by
backtracking: an Aho-Corasick automaton gives the longest piece at every position, a
piece is appended if it is compatible with the one before it, otherwise its next shorter
prefix is tried, and a position at which none fits is set in a bit field and never entered
again.  Two pieces are compatible if merging their joined text gives the same two pieces;
that is found by undoing their merges, latest first, and looking for a merge across the
border that would have come before the one just undone.  A sequence of pieces whose
neighbours are all compatible is the one that merging gives.

Decoding turns any ids back into text: control ids give nothing, byte ids their bytes
(U+FFFD for each byte that is not UTF-8), and the space put before a text goes.

Null texts count as empty: the end id alone, an empty text.  Long texts are encoded whole,
in time linear in their length; repeated rows and ids get equal rows; ids may be null;
further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, small_batches

SPACE = "▁"                    # stands for a space inside pieces
CACHE_PARTS = 500_000          # parts of texts whose ids a worker keeps, twice over
CACHE_CHARS = 40               # longer parts are not kept
# Letters that a vocabulary split by script never joins with anything else but the space
# before them; checked against the vocabulary.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"

CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
ENCODED_DDL, DECODED_DDL = "doc_id long, ids array<int>", "doc_id long, text string"
CODED_DDL = "doc_id long, ids array<int>, text string"


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The pieces of a merge-type model with what backtracking needs: ids, the order of
    merges, the two halves of each piece, its longest proper prefix that is a piece."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        """pieces: id and score of each piece; the higher the score, the earlier the merge."""
        self.ids = {p: i for p, (i, _) in pieces.items()}
        ranks = {s: r for r, s in enumerate(sorted({s for p, (_, s) in pieces.items() if len(p) > 1}, reverse=True), 1)}
        self.rank = {p: ranks[s] for p, (_, s) in pieces.items() if len(p) > 1}     # merges only
        self.halves: dict[str, tuple[str, str]] = {}
        tokens = []
        for p in pieces:
            if len(p) == 1:
                tokens.append(p)
            else:
                halves = self._last_merge(p)
                if halves:                       # else merging never gives this piece
                    self.halves[p] = halves
                    tokens.append(p)
        # in a trained vocabulary no piece comes before its own parts, so merges can be undone latest first
        self.ordered = all(self.rank.get(h, 0) <= self.rank[p] for p, halves in self.halves.items() for h in halves)
        known = set(tokens)
        # each piece and its prefixes that are pieces, longest first
        self.chains = {t: tuple(t[:n] for n in range(len(t), 0, -1) if t[:n] in known) for t in tokens}
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for t in self.halves:                    # single characters need no search
            self.automaton.add_word(t, (len(t), self.chains[t]))
        if self.halves:
            self.automaton.make_automaton()
        self.rows = _Rows(self)

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score and then leftmost first."""
        parts = list(text)
        while True:
            best, at = 0, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r and (at < 0 or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        parts = list(piece)
        while len(parts) > 1:
            r, at = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank),
                        default=(0, -1))
            if at < 0:
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return None

    def compatible(self, a: str, b: str) -> bool:
        """Merging ``a + b`` gives ``a`` and ``b``."""
        if not self.ordered:
            return self.merged(a + b) == [a, b]
        rank, before = self.rank, 1 << 60        # a merge across the border counts if it comes before this
        while True:
            across = rank.get(a + b)
            if across is not None and across < before:
                return False
            of_a, of_b = rank.get(a, 0), rank.get(b, 0)
            if of_a > of_b:                      # a was made last
                before, a = of_a, self.halves[a][1]
            elif of_b:                           # of equal merges the left one is made first
                before, b = of_b + 1, self.halves[b][0]
            else:
                return True

    def pieces(self, text: str) -> list[str]:
        """The pieces of ``text``; a character that no piece holds is one of its own."""
        n = len(text)
        starting: list[tuple[str, ...]] = [()] * n           # at each position its pieces, longest first
        if self.halves:
            for end, (size, chain) in self.automaton.iter(text):
                starting[end + 1 - size] = chain             # the longest comes last
        if n and starting[0] and len(starting[0][0]) == n:   # one piece: merging gives each piece itself
            return [text]
        failed = bytearray((n >> 3) + 1)                     # one bit a position
        out: list[str] = []
        at, rows, row = 0, self.rows, FIRST
        tries = starting[0] if n else ()
        while at < n:
            for token in tries or (text[at],):
                if row[token]:
                    end = at + len(token)
                    if not failed[end >> 3] >> (end & 7) & 1:
                        out.append(token)
                        if end < n:
                            tries = starting[end]
                        at, row = end, rows[token]
                        break
            else:
                tries = ()
                while not tries:                             # shorten the piece before
                    failed[at >> 3] |= 1 << (at & 7)
                    last = out.pop()
                    at -= len(last)
                    tries = self.chains.get(last, (last,))[1:]
                row = rows[out[-1]] if out else FIRST
        return out


class _Follows(dict):
    """Which pieces are compatible after one piece; found when first asked."""

    def __init__(self, vocabulary: Vocabulary, token: str):
        self.vocabulary, self.token = vocabulary, token

    def __missing__(self, other: str) -> bool:
        if len(self) > 20_000:
            self.clear()
        fits = self[other] = self.vocabulary.compatible(self.token, other)
        return fits


class _Rows(dict):
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> _Follows:
        if len(self) > 200_000:                              # characters that no piece holds
            self.clear()
        row = self[token] = _Follows(self.vocabulary, token)
        return row


class _First(dict):
    """Any piece can be the first."""

    def __missing__(self, token: str) -> bool:
        return True


FIRST = _First()


class Codec:
    """A merge-type model: whole texts to ids and back."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece.Type
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE:
            raise ValueError("not a merge-type model")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that leave characters as they are")
        if model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined or unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.vocabulary = Vocabulary({p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL})
        special = {p.type: i for i, p in enumerate(model.pieces)}
        self.unknown = special.get(kinds.UNKNOWN, 0)
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>"))
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown_text = model.trainer_spec.unk_surface or " ⁇ "
        self.surface = [b"" if p.type == kinds.CONTROL else self.unknown_text.encode() if p.type == kinds.UNKNOWN
                        else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE
                        else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.normal = [p.type == kinds.NORMAL for p in model.pieces]
        self.parts = re.compile(self._pattern())
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pattern(self) -> str:
        """Parts of a text between which no piece reaches."""
        pairs = {a + b for p in self.vocabulary.ids for a, b in zip(p, p[1:])}
        if any(a != SPACE and b == SPACE for a, b in pairs):
            return "(?s).+"
        latin = re.compile(f"[{LATIN}]")
        if any(a != SPACE and bool(latin.match(a)) != bool(latin.match(b)) for a, b in pairs):
            return " *[^ ]+| +"
        return f" *[{LATIN}]+| *[^ {LATIN}]+| +"

    def _part(self, part: str) -> bytes:
        """The ids of a part, as 32-bit numbers."""
        known = self.older.get(part)
        if known is None:
            ids: list[int] = []
            of = self.vocabulary.ids
            for piece in self.vocabulary.pieces(part.replace(" ", SPACE)):
                i = of.get(piece)
                if i is not None:
                    ids.append(i)
                elif self.byte_ids:
                    ids.extend(self.byte_ids[b] for b in piece.encode())
                elif not ids or ids[-1] != self.unknown:     # a run of unknown characters is one id
                    ids.append(self.unknown)
            known = array("i", ids).tobytes()
        if len(part) <= CACHE_CHARS:
            self.recent[part] = known
        return known

    def encode(self, text: str, end: bool = True) -> np.ndarray:
        if len(self.recent) > CACHE_PARTS:       # parts not met of late are forgotten
            self.recent, self.older = {}, self.recent
        text = text.replace(SPACE, " ")          # the two are one
        if self.prefix and text:
            text = " " + text
        find, make = self.recent.get, self._part
        raw = b"".join([find(p) or make(p) for p in self.parts.findall(text)])
        ids = np.frombuffer(raw, np.int32)
        return np.append(ids, np.int32(self.end)).astype(np.int32) if end else ids

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        listed = ids.tolist()
        found = [surface[i] for i in listed]
        if b"" in found[:-1]:                    # a control id ends a character's bytes
            texts, run = [], []
            for x in [*found, b""]:
                if x:
                    run.append(x)
                elif run:
                    texts.append(self._decode_bytes(b"".join(run)))
                    run = []
            text = "".join(texts)
        else:
            text = self._decode_bytes(b"".join(found))
        if self.prefix and text.startswith(" "):     # the space put before the text
            first = next(i for i, x in zip(listed, found) if x)
            if self.normal[first]:
                text = text[1:]
        return text

    @staticmethod
    def _decode_bytes(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:               # each byte that is no UTF-8 counts by itself
            return raw.decode(errors="each byte")


codecs.register_error("each byte", lambda e: ("\ufffd", e.start + 1))
_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                    pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("ids").fill_null([])
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each whole text of ``docs`` (doc_id, text), the end id last."""
    small_batches(docs.sparkSession)
    path = model or default_model()

    def run(batches):
        for batch in batches:
            yield record(ENCODED, batch.column("doc_id"), _lists([codec(path).encode(t) for t in _texts(batch)]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED_DDL)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of ``encoded`` (doc_id, ids array<int>); null ids count as none."""
    small_batches(encoded.sparkSession)
    path = model or default_model()

    def run(batches):
        for batch in batches:
            yield record(DECODED, batch.column("doc_id"), [codec(path).decode(i) for i in _ids(batch)])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, DECODED_DDL)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, text): each text's ids and what they decode to, in one pass."""
    small_batches(docs.sparkSession)
    path = model or default_model()

    def run(batches):
        for batch in batches:
            ids = [codec(path).encode(t) for t in _texts(batch)]
            yield record(CODED, batch.column("doc_id"), _lists(ids), [codec(path).decode(i) for i in ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CODED_DDL)


def query(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row a document."""
    return round_trip(docs, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
