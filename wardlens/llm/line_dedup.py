"""Line dedup by a log-template tree (operator 2).

A line descends a tree of fixed depth: first by its number of tokens, then by its
leading ``DEPTH`` tokens, where a token with a digit is a variable field.  In a leaf a
token stays constant if at least ``MIN_DOCS`` line occurrences of the leaf have it at
that place; the others become variable fields too.  A template recurs if it stands in
``MIN_DOCS`` documents and ``SIMILARITY`` of its tokens are constant; its lines are
dropped, but for the first (smallest doc_id and place), so nothing is lost altogether.

Leaves are counted on hashes first; texts are then read only for lines of leaves that
can recur.  No group is gathered: constants, templates and documents are aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, store, text_key, with_key

DEPTH = 3
MIN_DOCS = 10
SIMILARITY = 0.8
FIELD = "<*>"
BLANKS = r"[ \\t\\x0B\\f\\r]+"       # as a SQL literal

LINES = "split(text, '\\n')"
TOKENS = f"filter(split(line, '{BLANKS}'), t -> t != '')"


def _masked(tokens: str) -> str:
    return f"transform({tokens}, t -> if(t rlike '[0-9]', '{FIELD}', t))"


def _leaf(depth: int) -> Column:
    lead = _masked(f"slice(tokens, 1, {depth})")
    return F.when(F.size("tokens") > 0, F.expr(f"xxhash64(size(tokens), {lead})"))


def hot_leaves(rows: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """(leaf) that lines of at least ``min_docs`` documents reach."""
    leaves = rows.select(F.explode(F.array_distinct(_leaf_array(depth))).alias("leaf")).where("leaf is not null")
    return leaves.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf")


def _leaf_array(depth: int) -> Column:
    lead = _masked(f"slice(x, 1, {depth})")
    tokens = TOKENS.replace("line", "l")
    return F.expr(f"transform(transform({LINES}, l -> {tokens}), x -> if(size(x) > 0, xxhash64(size(x), {lead}), null))")


def candidate_lines(rows: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """(id, tkey, pos, leaf, masked) of all lines in hot leaves."""
    hot = hot_leaves(rows, depth, min_docs)
    places = rows.select("id", "tkey", F.posexplode(_leaf_array(depth)).alias("pos", "leaf")).where("leaf is not null") \
        .join(hot, "leaf", "left_semi").groupBy("id", "tkey").agg(F.collect_set("pos").alias("places"))   # of one text
    # always by sorting: either side grows with the corpus
    lines = rows.join(places.hint("merge"), ["id", "tkey"]) \
        .select("id", "tkey", F.expr(f"posexplode(transform({LINES}, (l, i) -> if(array_contains(places, i), l, null)))").alias("pos", "line")) \
        .where("line is not null").withColumn("tokens", F.expr(TOKENS))
    return lines.select("id", "tkey", "pos", _leaf(depth).alias("leaf"), F.expr(_masked("tokens")).alias("masked"))


def recurring(lines: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """(id, tkey, pos) of the candidate lines to drop."""
    lines = lines.withColumn("line_key", F.xxhash64("masked"))
    distinct = lines.groupBy("leaf", "line_key", "masked").agg(F.count("*").alias("n"))
    words = distinct.select("leaf", "line_key", "n", F.posexplode("masked").alias("at", "word"))
    constant = words.groupBy("leaf", "at", "word").agg(F.sum("n").alias("n")) \
        .where((F.col("n") >= min_docs) & (F.col("word") != FIELD)).select("leaf", "at", "word", F.lit(1).alias("fixed"))
    templates = words.join(constant, ["leaf", "at", "word"], "left").groupBy("leaf", "line_key").agg(
        F.array_sort(F.collect_list(F.struct("at", F.when(F.col("fixed") == 1, F.col("word")).otherwise(FIELD).alias("w")))).alias("t"),
        F.count("fixed").alias("n_fixed"), F.count("*").alias("n_words"))
    templates = templates.where(F.col("n_fixed") >= similarity * F.col("n_words")) \
        .select("leaf", "line_key", F.xxhash64(F.col("t.w")).alias("template"))
    found = store(lines.join(templates, ["leaf", "line_key"]).select("leaf", "template", "id", "tkey", "pos"), "op2-found")
    docs = found.groupBy("leaf", "template", "id").agg(F.min(F.struct("tkey", "pos")).alias("first")) \
        .groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min(F.struct("id", "first")).alias("f")) \
        .where(F.col("docs") >= min_docs)
    first = (F.col("id") == F.col("f.id")) & (F.col("tkey") == F.col("f.first.tkey")) & (F.col("pos") == F.col("f.first.pos"))
    return found.join(docs, ["leaf", "template"]).where(~first).select("id", "tkey", "pos")


def line_dedup(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """The columns of ``docs``, text without the dropped lines, and lines_total,
    lines_dropped (columns of ``docs`` with these two names are replaced).

    Blank lines stay.  A null text stays null with no lines; a null doc_id comes last
    when the first line of a template is chosen; repeated rows are one document and get
    equal results; an empty table gives an empty result."""
    rows = doc_rows(docs).withColumn("tkey", text_key())
    lines = store(candidate_lines(rows, depth, min_docs).distinct(), "op2-lines")
    drop = recurring(lines, min_docs, similarity).groupBy("id", "tkey").agg(F.collect_set("pos").alias("_drop"))
    drop = store(drop.select(F.col("id").alias("_id"), F.col("tkey").alias("_tkey"), "_drop"), "op2-drop")
    out = with_key(docs).join(drop.hint("merge"), ["_id", "_tkey"], "left").withColumn("text", F.col("doc.text"))
    kept = F.expr(f"array_join(filter({LINES}, (l, i) -> not array_contains(_drop, i)), '\\n')")
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept)
    total = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.expr(LINES))).cast("long")
    names = [c for c in docs.columns if c not in ("lines_total", "lines_dropped")]
    return out.select(*[text.alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in names], total.alias("lines_total"),
                      F.greatest(F.size("_drop"), F.lit(0)).cast("long").alias("lines_dropped"))


def without_recurring(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs``; n_chars, if there, is that of the text left (and two
    columns named like the counts hold these)."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "lines_total", "lines_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


# Blank characters are those of BLANKS; the constants are the defaults above.
ORACLE_SQL = rf"""
    WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line
               FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
         m AS (SELECT doc_id, pos, line, list_transform(list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda t: t <> ''),
                      lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END) AS masked FROM l),
         k AS (SELECT *, (len(masked), masked[1:{DEPTH}])::VARCHAR AS leaf FROM m WHERE len(masked) > 0),
         hot AS (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
         c AS (SELECT * FROM k WHERE leaf IN (SELECT leaf FROM hot)),
         w AS (SELECT leaf, masked, n, generate_subscripts(masked, 1) AS place, unnest(masked) AS word
               FROM (SELECT leaf, masked, count(*) AS n FROM c GROUP BY ALL)),
         f AS (SELECT leaf, place, word FROM w WHERE word <> '{FIELD}' GROUP BY ALL HAVING sum(n) >= {MIN_DOCS}),
         t AS (SELECT leaf, masked, list(CASE WHEN f.word IS NULL THEN '{FIELD}' ELSE w.word END ORDER BY w.place) AS template,
                      count(f.word) AS fixed, count(*) AS words
               FROM w LEFT JOIN f USING (leaf, place, word) GROUP BY leaf, masked),
         o AS (SELECT c.doc_id, c.pos, t.leaf, t.template FROM c JOIN t ON c.leaf = t.leaf AND c.masked = t.masked
               WHERE t.fixed >= {SIMILARITY} * t.words),
         r AS (SELECT leaf, template, min((doc_id, pos)) AS one FROM o GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
         d AS (SELECT o.doc_id, o.pos FROM o JOIN r ON o.leaf = r.leaf AND o.template = r.template WHERE (o.doc_id, o.pos) <> r.one),
         j AS (SELECT l.doc_id, count(*) AS lines_total, count(d.pos) AS lines_dropped,
                      coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (d.pos IS NULL), '') AS text
               FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.pos = d.pos GROUP BY l.doc_id)
    SELECT doc_id, lines_total, lines_dropped, length(text) AS n_chars, sha256(text) AS text_sha256 FROM j"""
