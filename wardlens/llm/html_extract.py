"""HTML extraction by nearest-URL page differencing (operator 5).

Pages of a host are ordered by URL path; each is paired with the neighbour whose path
shares the longer prefix.  The text lines (blocks) of both are aligned by their longest
common subsequence, and lines in it are template text of the site and deleted.  Markup
decides where differencing alone errs: lines inside an article or main element are kept
though a neighbour has them too (a passage may be quoted on two pages), and lines inside
navigation, footers, adverts, forms and the like are deleted though no neighbour has
them.  A page without such an element rests on the differencing.
"""

from __future__ import annotations

import html
import re
from os.path import commonprefix
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import ranked_within
from .common import NO_ID, as_doc_id, record, small_batches, store, strings_of

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CHROME = frozenset("nav footer aside form button select option menu dialog noscript template svg iframe object canvas audio video head title textarea".split())
MAIN = frozenset("article main".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead social share
    sharing comment comments disqus replies related recommended widget toolbar pagination pager login signup search""".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PARTS = re.compile(r"[\s_:-]+")

ROLE_MAIN, ROLE_BODY, ROLE_CHROME = 0, 1, 2
LINES = pa.schema([("id", pa.int64()), ("k", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64()))])
PAGE = pa.schema([("id", pa.int64()), ("k", pa.int64()), ("url", pa.string()), ("texts", pa.list_(pa.string())), ("roles", pa.list_(pa.int32()))])
SHARED = pa.schema([("id", pa.int64()), ("k", pa.int64()), ("shared", pa.list_(pa.int32()))])


def _is_chrome(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in CHROME or tag == "header" and not in_main:
        return True
    if not attributes or not attributes.strip("/ \n\t"):
        return False
    low = attributes.lower()
    for name, *values in ATTRIBUTE.findall(low):
        value = "".join(values)
        if name in ("class", "id"):
            if not CHROME_NAMES.isdisjoint(NAME_PARTS.split(value)):
                return True
        elif name == "role" and value in CHROME_ROLES or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", ATTRIBUTE.sub("", low)))


def blocks(page: str) -> list[tuple[str, int]]:
    """Text blocks in page order with their role; character references decoded, white
    space within a block one space."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []      # open elements, with the role in force inside
    role, at = ROLE_BODY, 0

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, role))
            parts.clear()

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag not in INLINE or opened is not None and stack[opened][1] != role:
                flush()
            if opened is not None and (tag not in INLINE or all(t in INLINE for t, _ in stack[opened:])):
                del stack[opened:]
                role = stack[-1][1] if stack else ROLE_BODY
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        inside = role
        if role != ROLE_CHROME:
            if _is_chrome(tag, m[4], role == ROLE_MAIN):
                inside = ROLE_CHROME
            elif tag in MAIN or re.search(r"\brole\s*=\s*[\"']?main\b", m[4]):
                inside = ROLE_MAIN
        if tag not in INLINE or inside != role:
            flush()
        if not m[4].endswith("/") or tag not in ("svg", "path", "use"):
            stack.append((tag, inside))
            role = inside
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def split_url(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit((url or "").strip())
        return (u.hostname or "").lower(), u.path or "/"
    except ValueError:
        return "", url or ""


def common_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``."""
    out: list[int] = []

    def row(x, y):
        last = np.zeros(len(y) + 1, np.int32)
        for v in x:
            step = np.maximum(last[1:], last[:-1] + (y == v))
            last = np.concatenate([[0], np.maximum.accumulate(step)]).astype(np.int32)
        return last

    def solve(x, y, at):                       # halves by Hirschberg: memory of one row
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        out.extend(range(at, at + n))
        x, y, at = x[n:], y[n:], at + n
        end = 0
        while end < min(len(x), len(y)) and x[-1 - end] == y[-1 - end]:
            end += 1
        tail = range(at + len(x) - end, at + len(x))
        x, y = x[:len(x) - end], y[:len(y) - end]
        if len(x) and len(y):
            if len(x) == 1:
                if (y == x[0]).any():
                    out.append(at)
            else:
                mid = len(x) // 2
                cut = int(np.argmax(row(x[:mid], y) + row(x[mid:][::-1], y[::-1])[::-1]))
                solve(x[:mid], y[:cut], at)
                solve(x[mid:], y[cut:], at + mid)
        out.extend(tail)

    keep = np.flatnonzero(np.isin(a, b))       # lines of one page alone are in no alignment
    solve(a[keep], b[np.isin(b, a)], 0)
    return keep[sorted(out)].tolist()


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"), "url",
                        F.coalesce(F.col("html"), F.lit("")).alias("html"), F.xxhash64("url", "html").alias("k"))


def _parsed(batch) -> list[list[tuple[str, int]]]:
    return [blocks(t.decode("utf-8", "replace")) for t in strings_of(batch.column("html"))]


def _line_hashes(batches):
    for b in batches:
        where = [split_url(u) for u in b.column("url").to_pylist()]
        lines = [[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in page] for page in _parsed(b)]
        yield record(LINES, b.column("id"), b.column("k"), [w[0] for w in where], [w[1] for w in where], lines)


def _texts(batches):
    for b in batches:
        pages = _parsed(b)
        # deleted chrome needs no text further on, only its place
        yield record(PAGE, b.column("id"), b.column("k"), b.column("url"),
                     [[t if r != ROLE_CHROME else "" for t, r in page] for page in pages], [[r for _, r in page] for page in pages])


def _align(batches):
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in ("path", "lines", "p_path", "p_lines", "n_path", "n_lines")}
        shared = []
        for path, lines, pp, pl, np_, nl in zip(*cols.values()):
            near = lambda other: -1 if other is None else len(commonprefix([path, other]))
            other = pl if near(pp) >= near(np_) else nl
            shared.append([] if not other else common_lines(np.array(lines, np.int64), np.array(other, np.int64)))
        yield record(SHARED, b.column("id"), b.column("k"), shared)


def shared_lines(rows: DataFrame) -> DataFrame:
    """(id, k, shared): for each page the positions of the lines that its nearest page of
    the same host has too.  Neighbours meet by rank, so a host of any size is spread."""
    lines = rows.select("id", "k", "url", "html").mapInArrow(_line_hashes, "id long, k long, host string, path string, lines array<long>") \
        .dropDuplicates(["id", "k"])
    ranked = ranked_within(lines, ["host"], ["path", "id", "k"]).select("host", "path", "id", "k", "lines", F.col("_rank").cast("long").alias("r"))
    side = lambda p, step: ranked.select(F.col("host"), (F.col("r") + step).alias("r"), F.col("path").alias(f"{p}_path"), F.col("lines").alias(f"{p}_lines"))
    return (ranked.join(side("p", 1), ["host", "r"], "left").join(side("n", -1), ["host", "r"], "left")
            .select("id", "k", "path", "lines", "p_path", "p_lines", "n_path", "n_lines")
            .mapInArrow(_align, "id long, k long, shared array<int>"))


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_lines, n_shared.

    Null or empty html gives an empty text.  A page alone on its host shares nothing;
    pages without a readable URL form a host of their own; repeated rows (equal id, url
    and html) get equal results; ties in nearness go to the page before."""
    small_batches(pages.sparkSession)
    rows = _pages(pages)
    texts = rows.mapInArrow(_texts, "id long, k long, url string, texts array<string>, roles array<int>")
    # always by sorting: what is deleted grows with the corpus
    cut = texts.join(store(shared_lines(rows), "op5-shared").hint("merge"), ["id", "k"], "left")
    kept = F.expr(f"""filter(transform(texts, (t, i) -> named_struct('t', t, 'r', roles[i], 'i', i)),
        x -> x.r = {ROLE_MAIN} or (x.r = {ROLE_BODY} and not array_contains(roles, {ROLE_MAIN})
                                   and not array_contains(coalesce(shared, array()), x.i)))""")
    text = F.concat_ws("\n\n", kept["t"])
    return cut.select(as_doc_id().alias("page_id"), "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"),
                      F.size("texts").cast("long").alias("n_lines"), F.greatest(F.size("shared"), F.lit(0)).cast("long").alias("n_shared"))
