"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (exact_dedup, html_extract, importance_resampling, jaccard_join, language_id, lexical_scan, license_scan, line_dedup,
               mixing, nearest, packing, sentencepiece_codec, suffix_dedup)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": lambda spark, d: suffix_dedup.suffix_dedup(table(spark, d, "documents")),
    "op2_line_dedup": lambda spark, d: line_dedup.query(table(spark, d, "documents")),
    "op3_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(table(spark, d, "documents")),
    "op4_jaccard_join": lambda spark, d: jaccard_join.jaccard_join(table(spark, d, "documents")),
    "op5_html_extract": lambda spark, d: html_extract.extract(table(spark, d, "pages")),
    "op6_mixing": lambda spark, d: mixing.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_language_id": lambda spark, d: language_id.language_id(table(spark, d, "documents")),
    "op8_license_scan": lambda spark, d: license_scan.license_scan(table(spark, d, "documents")),
    "op9_packing": lambda spark, d: packing.pack_documents(table(spark, d, "documents")),
    "op10_nearest_neighbours": lambda spark, d: nearest.nearest(table(spark, d, "embeddings")),
    "op11_sentencepiece": lambda spark, d: sentencepiece_codec.query(table(spark, d, "documents")),
    "op12_lexical_scan": lambda spark, d: lexical_scan.search(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op13_importance_resampling": lambda spark, d: importance_resampling.resample(table(spark, d, "documents"),
                                                                                 table(spark, d, "benchmark")),
}

ORACLE: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op12_lexical_scan": lexical_scan.ORACLE_SQL,
    "op13_importance_resampling": importance_resampling.ORACLE_SQL,
    "op3_exact_dedup": r"""
        WITH k AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
             r AS (SELECT *, count(*) OVER (PARTITION BY body) AS group_size,
                          first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id) AS keep_id FROM k)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256, n_chars FROM r""",
}
