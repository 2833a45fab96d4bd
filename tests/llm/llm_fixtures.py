"""Fixtures of the llm tests."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASH = ("id", "tkey", "row", "_id", "_tkey", "n", "h", "word", "line", "tokens", "kind", "place", "rank", "shard", "text_key")


def documents(spark, rows, clash=False):
    """rows: (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *[F.lit(f"x {c}").alias(c) for c in CLASH]) if clash else df


def prose(rng, words, syllables=("ka", "lo", "mi", "ru", "ten", "sha", "vor", "el", "an", "qui")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words))


def edge_rows(seed=3):
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    near = base.split(" ")
    near[50] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, base.replace(" ", "\n  ")),
            (6, None), (7, ""), (8, " \t\n"), (None, "no id " + passage), (None, base), (9, "one two"), (10, "one  TWO"),
            (11, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)), (12, passage), (12, passage), (13, "a" * 5000),
            (14, "b" + "a" * 200), (15, "日本語のテキスト çé ß İ ½ 12"), (16, prose(rng, 60_000)), (17, "x" * 300_000), (18, "12 34 !!")]
    return rows + [(100 + i, f"user {i} logged in from the main office at gate{i} as usual\n" + prose(rng, 20) + "\nAll rights reserved.") for i in range(14)]
