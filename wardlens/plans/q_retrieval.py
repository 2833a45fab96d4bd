"""Registered retrieval queries (survey 2.16).

Bindings: dense retrieval runs on ``embeddings`` (queries = one exemplar per label,
the smallest id of the label; candidates = every other vector; relevant = same
label).  Lexical retrieval runs on ``documents`` with the ``benchmark`` passages as
queries; a document is relevant to a passage when it contains it.  The driver
tables carry no document vectors and there is no embedding model, so the dense list
of the hybrid comes from hashed-term vectors (``text_vectors``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as RV
from ..sources.files import materialise
from ..sources.tables import read_table
from .registry import query

K_DENSE, K_LEX = 5, 10


def dense_inputs(spark, sf):
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    ex = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    q = e.join(ex, ["label", "vec_id"], "left_semi").select(F.col("vec_id").alias("query_id"),
                                                            F.col("embedding").alias("query_vec"), "label")
    corpus = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")
    rel = q.select("query_id", "label").join(corpus.select("item_id", "label"), "label") \
        .where(F.col("query_id") != F.col("item_id")).select("query_id", "item_id")
    return q, corpus, rel


def dense_ranked(spark, sf, k=K_DENSE):
    q, corpus, _ = dense_inputs(spark, sf)
    return RV.dense_topk(q.select("query_id", "query_vec"), corpus.select("item_id", "vec"), k)


DENSE_SQL = """q AS (SELECT vec_id AS query_id, embedding AS qv, label FROM embeddings
  WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
sc AS (SELECT q.query_id, c.vec_id AS item_id, round(list_inner_product(list_transform(q.qv, lambda x: CAST(x AS DOUBLE)),
  list_transform(c.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score FROM q JOIN embeddings c ON c.vec_id <> q.query_id),
dense AS (SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, item_id) AS rank FROM sc) WHERE rank <= {k}),
rel AS (SELECT q.query_id, c.vec_id AS item_id FROM q JOIN embeddings c ON c.label = q.label AND c.vec_id <> q.query_id)"""


@query("dense_topk", "WITH " + DENSE_SQL.format(k=K_DENSE) + " SELECT * FROM dense")
def q_dense_topk(spark, sf):
    return dense_ranked(spark, sf)


@query("win_topk_per_query", "WITH " + DENSE_SQL.format(k=3) + " SELECT query_id, item_id, rank FROM dense")
def q_win_topk_per_query(spark, sf):
    return dense_ranked(spark, sf, 3).select("query_id", "item_id", "rank")


TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def bm25_sql(name: str, docs: str, doc_id: str, queries: str, qid: str, k: int | None, k1: float = 1.2, b: float = 0.75) -> str:
    tok = TOK.replace("{{", "{").replace("}}", "}")
    return f"""{name}_te AS (SELECT item_id, len(toks) AS doc_len, unnest(toks) AS term FROM (
  SELECT {doc_id} AS item_id, {tok} AS toks FROM {docs})),
{name}_post AS (SELECT term, item_id, doc_len, count(*) AS tf FROM {name}_te GROUP BY 1, 2, 3),
{name}_st AS (SELECT count(*) AS n_docs, avg(doc_len) AS avgdl FROM (SELECT DISTINCT item_id, doc_len FROM {name}_te)),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_post GROUP BY 1),
{name}_qt AS (SELECT DISTINCT query_id, term FROM (SELECT {qid} AS query_id, unnest({tok}) AS term FROM {queries})),
{name}_sc AS (SELECT qt.query_id, p.item_id, round(sum(ln(1 + ((SELECT n_docs FROM {name}_st) - d.df + 0.5) / (d.df + 0.5))
    * p.tf * ({k1} + 1) / (p.tf + {k1} * (1 - {b} + {b} * p.doc_len / (SELECT avgdl FROM {name}_st)))), 6) AS score
  FROM {name}_qt qt JOIN {name}_df d ON qt.term = d.term JOIN {name}_post p ON p.term = qt.term GROUP BY 1, 2),
{name} AS (SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {name}_sc){"" if k is None else f" WHERE rank <= {k}"})"""


def bm25_ranked(spark, sf, k=K_LEX, b=0.75):
    return RV.bm25_topk(read_table(spark, sf, "benchmark", "item_id", "text"),
                        read_table(spark, sf, "documents", "doc_id", "text"), k, b=b)


@query("bm25_topk", "WITH " + bm25_sql("bm", "documents", "doc_id", "benchmark", "item_id", K_LEX) + " SELECT * FROM bm")
def q_bm25_topk(spark, sf):
    return bm25_ranked(spark, sf)


def text_vectors_sql(name: str, table: str, key: str) -> str:
    """DuckDB twin of ``text_vectors``."""
    tok = TOK.replace("{{", "{").replace("}}", "}")
    return f"""{name}_tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT {key} AS item_id, unnest({tok}) AS term FROM {table}) GROUP BY 1, 2),
{name}_hit AS (SELECT item_id, tf, CAST('0x' || substr(md5(term), 8 * j + 1, 8) AS BIGINT) AS w FROM {name}_tf, range({RV.TEXT_HITS}) r(j)),
{name}_sum AS (SELECT item_id, w % {RV.TEXT_DIMS} AS dim, CAST(sum(CASE WHEN (w // {RV.TEXT_DIMS}) % 2 = 0 THEN tf ELSE -tf END) AS BIGINT) AS v
  FROM {name}_hit GROUP BY 1, 2),
{name}_norm AS (SELECT item_id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS norm FROM {name}_sum GROUP BY 1 HAVING sum(v * v) > 0),
{name} AS (SELECT s.item_id, dim, v / norm AS x FROM {name}_sum s JOIN {name}_norm n ON s.item_id = n.item_id)"""


@query("text_vectors", "WITH " + text_vectors_sql("tv", "documents", "doc_id") + """
SELECT item_id, CAST(dim AS INTEGER) AS dim, round(x, 9) AS x FROM tv WHERE x <> 0""")
def q_text_vectors(spark, sf):
    v = RV.text_vectors(read_table(spark, sf, "documents", "doc_id", "text"))
    return v.select("item_id", F.posexplode("vec").alias("dim", "x")).where("x <> 0").select("item_id", "dim", F.round("x", 9).alias("x"))


@query("hybrid_rrf", "WITH " + bm25_sql("ba", "documents", "doc_id", "benchmark", "item_id", 50) + ", "
       + text_vectors_sql("dv", "documents", "doc_id") + ", " + text_vectors_sql("qv", "benchmark", "item_id") + """,
ds AS (SELECT q.item_id AS query_id, d.item_id, round(sum(q.x * d.x), 6) AS score FROM qv q JOIN dv d ON q.dim = d.dim GROUP BY 1, 2),
dn AS (SELECT q.item_id AS query_id, d.item_id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT item_id FROM qv) q, (SELECT DISTINCT item_id FROM dv) d
  LEFT JOIN ds s ON s.query_id = q.item_id AND s.item_id = d.item_id),
bb AS (SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dn) WHERE rank <= 50),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item_id, b.item_id) AS item_id,
  round(coalesce(1.0 / (60 + a.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0), 6) AS score
  FROM ba a FULL JOIN bb b ON a.query_id = b.query_id AND a.item_id = b.item_id)
SELECT query_id, item_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f) WHERE rank <= 10""")
def q_hybrid_rrf(spark, sf):
    """BM25 and dense lists of 50 each, fused."""
    items, docs = read_table(spark, sf, "benchmark", "item_id", "text"), read_table(spark, sf, "documents", "doc_id", "text")
    dense = RV.dense_topk(RV.text_vectors(items, "item_id").select(F.col("item_id").alias("query_id"), F.col("vec").alias("query_vec")),
                          RV.text_vectors(docs), RV.HYBRID_CANDIDATES, exclude_self=False)
    return RV.hybrid_rrf(RV.bm25_topk(items, docs, RV.HYBRID_CANDIDATES), dense, K_LEX)


CHUNK_SQL = """cw AS (SELECT doc_id, regexp_split_to_array(trim(text), '\\s+') AS words FROM documents),
cn AS (SELECT doc_id, words, CASE WHEN len(words) <= 512 THEN 1 ELSE CAST(ceil((len(words) - 512) / 448) AS INTEGER) + 1 END AS nc FROM cw),
cs AS (SELECT doc_id, words, unnest(generate_series(0, (nc - 1) * 448, 448)) AS start FROM cn),
chunks AS (SELECT CAST(doc_id AS VARCHAR) || '::' || CAST(start // 448 AS VARCHAR) AS chunk_id, doc_id,
  CAST(start // 448 AS INTEGER) AS chunk_no, CAST(len(words[start + 1:start + 512]) AS INTEGER) AS n_tokens,
  array_to_string(words[start + 1:start + 512], ' ') AS text FROM cs)"""


@query("chunk_documents", f"WITH {CHUNK_SQL} SELECT chunk_id, doc_id, chunk_no, n_tokens, sha256(text) AS text_sha FROM chunks")
def q_chunk_documents(spark, sf):
    c = RV.chunk_documents(read_table(spark, sf, "documents", "doc_id", "text"))
    return c.select("chunk_id", "doc_id", "chunk_no", "n_tokens", F.sha2("text", 256).alias("text_sha"))


def chunk_hits(spark, sf, k=K_LEX):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    hits = RV.bm25_topk(read_table(spark, sf, "benchmark", "item_id", "text"), RV.chunk_documents(docs).select("chunk_id", "text"), k,
                        did="chunk_id")
    return RV.with_parents(hits, docs)


CHUNK_HITS_SQL = CHUNK_SQL + ", " + bm25_sql("ch", "chunks", "chunk_id", "benchmark", "item_id", K_LEX) + """,
hits AS (SELECT ch.*, c.doc_id FROM ch JOIN chunks c ON c.chunk_id = ch.item_id)"""


@query("doc_rollup_max", f"WITH {CHUNK_HITS_SQL} SELECT query_id, doc_id, max(score) AS best_score FROM hits GROUP BY 1, 2")
def q_doc_rollup_max(spark, sf):
    return RV.doc_rollup_max(chunk_hits(spark, sf))


@query("doc_ids_ordered", f"""WITH {CHUNK_HITS_SQL}, g AS (SELECT query_id, doc_id, min(rank) AS best_rank FROM hits GROUP BY 1, 2)
SELECT query_id, doc_id, best_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best_rank, doc_id) AS INTEGER) AS doc_position FROM g""")
def q_doc_ids_ordered(spark, sf):
    return RV.doc_ids_ordered(chunk_hits(spark, sf))


@query("attribution_check", f"""WITH {CHUNK_SQL} SELECT chunk_id, doc_id FROM chunks c
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id)""")
def q_attribution_check(spark, sf):
    """Chunks checked against the labelled documents: chunks of unlabelled documents
    have no parent in that catalogue and are reported."""
    c = RV.chunk_documents(read_table(spark, sf, "documents", "doc_id", "text"))
    return RV.attribution_check(c, read_table(spark, sf, "labels", "doc_id"))


CONTAINS_REL_SQL = """lrel AS (SELECT b.item_id AS query_id, d.doc_id AS item_id FROM benchmark b JOIN documents d
  ON contains(lower(d.text), lower(b.text)))"""


@query("retrieval_recall", "WITH " + DENSE_SQL.format(k=K_DENSE) + ", " + bm25_sql("bm", "documents", "doc_id", "benchmark", "item_id", K_LEX)
       + ", " + CONTAINS_REL_SQL + """,
dq AS (SELECT d.query_id, bool_or(rank = 1 AND r.item_id IS NOT NULL) AS top1, bool_or(rank <= 3 AND r.item_id IS NOT NULL) AS at3,
  bool_or(rank <= 5 AND r.item_id IS NOT NULL) AS at5, (SELECT count(*) FROM rel WHERE rel.query_id = d.query_id) AS n_rel
  FROM dense d LEFT JOIN rel r ON r.query_id = d.query_id AND r.item_id = d.item_id GROUP BY 1),
lq AS (SELECT d.query_id, bool_or(rank = 1 AND r.item_id IS NOT NULL) AS top1, bool_or(rank <= 3 AND r.item_id IS NOT NULL) AS at3,
  bool_or(rank <= 5 AND r.item_id IS NOT NULL) AS at5, (SELECT count(*) FROM lrel WHERE lrel.query_id = d.query_id) AS n_rel
  FROM bm d LEFT JOIN lrel r ON r.query_id = d.query_id AND r.item_id = d.item_id GROUP BY 1)
SELECT 'dense' AS strategy, count(*) AS n_queries, count(*) FILTER (WHERE n_rel = 0) AS n_without_relevant,
  count(*) FILTER (WHERE top1) AS top1, count(*) FILTER (WHERE at3) AS recall_at_3, count(*) FILTER (WHERE at5) AS recall_at_5 FROM dq
UNION ALL SELECT 'bm25', count(*), count(*) FILTER (WHERE n_rel = 0), count(*) FILTER (WHERE top1), count(*) FILTER (WHERE at3),
  count(*) FILTER (WHERE at5) FROM lq""")
def q_retrieval_recall(spark, sf):
    from ..operators.screening import phrase_screen
    _, _, rel = dense_inputs(spark, sf)
    d = RV.retrieval_recall(dense_ranked(spark, sf), rel, "dense")
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    bench = read_table(spark, sf, "benchmark", "item_id", "text")
    # one row for each text with its phrase, read by two sides of the recall
    lrel = materialise(phrase_screen(docs, bench).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("item_id")), "contained")
    b = RV.retrieval_recall(bm25_ranked(spark, sf), lrel, "bm25")
    return d.unionByName(b)


@query("retrieval_metrics", "WITH " + DENSE_SQL.format(k=K_DENSE) + """,
j AS (SELECT d.query_id, d.rank, CASE WHEN r.item_id IS NOT NULL THEN 1.0 ELSE 0.0 END AS g FROM dense d
  LEFT JOIN rel r ON r.query_id = d.query_id AND r.item_id = d.item_id),
nr AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1),
per AS (SELECT j.query_id, sum(g) / 5 AS p, max(CASE WHEN g > 0 THEN 1.0 / rank END) AS rr, sum(g / log2(rank + 1.0)) AS dcg,
  any_value(nr.n_rel) AS n_rel FROM j LEFT JOIN nr ON nr.query_id = j.query_id GROUP BY 1),
nd AS (SELECT *, CASE WHEN n_rel > 0 THEN dcg / (SELECT sum(1.0 / log2(i + 1.0)) FROM range(1, least(n_rel, 5) + 1) t(i)) ELSE 0.0 END AS ndcg FROM per)
SELECT round(avg(p), 9) AS precision_at_k, round(avg(coalesce(rr, 0.0)), 9) AS mrr, round(avg(ndcg), 9) AS ndcg_at_k FROM nd""")
def q_retrieval_metrics(spark, sf):
    _, _, rel = dense_inputs(spark, sf)
    return RV.retrieval_metrics(dense_ranked(spark, sf), rel, K_DENSE)


LINK_PATTERN = 'href="(/[^"]*)"'


@query("link_integrity", """WITH l AS (SELECT page_id AS source_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS target FROM pages),
t AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS target FROM pages),
n AS (SELECT source_id, count(*) AS n_links FROM l GROUP BY 1),
d AS (SELECT source_id, count(*) AS n_dangling FROM l WHERE target NOT IN (SELECT target FROM t) GROUP BY 1)
SELECT n.source_id, n_links, coalesce(n_dangling, 0) AS n_dangling FROM n LEFT JOIN d ON n.source_id = d.source_id""")
def q_link_integrity(spark, sf):
    """In-site links of every page against the set of page paths that exist."""
    p = read_table(spark, sf, "pages", "page_id", "url", "html")
    targets = p.select(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("target"))
    return RV.link_integrity(p, LINK_PATTERN, "page_id", targets)
