"""Mixing sources to target weights by soft membership (operator 6); DataFrame
functions only.

The classifier learns from the labelled table which words mark a domain (their documents
there are far more than chance), and then how often documents of each domain have how
many marking words and which traits; by naive Bayes over these few counts it gives every
document a posterior over the domains.  Nonnegative document rates are then fitted by
projected-gradient least squares, so that the expected tokens of each domain (rate x
tokens x posterior, summed) match the targets.

With residuals weighted by each domain's tokens, the step matrix is row-stochastic, so a
step of 1 never overshoots.  A rate is a fold of its posterior over the steps so far;
each round is one aggregation to one number a domain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_doc_id, doc_rows, own_columns, store, text_key, with_key

DOMAINS = ("clean", "low", "toxic")
DOMAIN_OF = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' ELSE 'clean' END"
WEIGHTS = {"clean": 0.97, "low": 0.03, "toxic": 0.0}
REPEAT = 1.05          # target tokens of the clean domain, times what the corpus has
SAMPLE = 20_000        # labelled documents to learn from, on average
FEATURES = 8_192       # words of the model
MIN_DOCS, MIN_SHARE = 4, 300   # labelled documents with a word of the model: so many, and one in so many
GAIN = 6.0             # standard deviations that a marking word's documents are above chance
TOP = 10               # traits are counted from 0 to this
ROUNDS, CLOSE = 30, 1e-3

TOKENS = r"filter(split(lower(text), '[ \\t\\r\\n\\f\\x0B]+'), t -> t != '')"
WORDS = r"""array_distinct(transform(tokens, t -> btrim(t, '.,;:!?"()')))"""
# tenths of the tokens: different ones, ones of a single byte, ones that end in a mark
SHARES = {"different": "array_distinct(tokens)", "single": "filter(tokens, t -> octet_length(t) = 1)",
          "marked": "filter(tokens, t -> instr('!@#$%&*+-=/<>|~^_', right(t, 1)) > 0)"}
MARKED = [d for d in DOMAINS if d != "clean"]
TRAITS = [*SHARES, *(f"k_{d}" for d in MARKED)]


def domain_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, domain) of about ``sample`` labelled documents, by a hash of the id; rows with
    a null teach nothing, and of contradicting rows toxic, then low wins."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic") \
        .where("doc_id is not null and quality is not null and toxic is not null") \
        .groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    n = rows.count()
    share = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("id", F.expr(DOMAIN_OF).alias("domain"))


def marking_words(texts: DataFrame, size: dict[str, int], features: int = FEATURES) -> DataFrame:
    """(word, domain): words of one domain, at most ``features``."""
    total = max(sum(size.values()), 1)
    counts = texts.select("domain", F.expr(TOKENS).alias("tokens")).select("domain", F.explode(F.expr(WORDS)).alias("word")) \
        .groupBy("word").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{d}") for d in MARKED])
    expected = {d: F.col("n") * size.get(d, 0) / total for d in MARKED}
    gains = [F.struct(((F.col(f"n_{d}") - x) / F.sqrt(x + 1.0)).alias("gain"), F.lit(d).alias("domain")) for d, x in expected.items()]
    best = counts.where(F.col("n") >= max(MIN_DOCS, total // MIN_SHARE)).select("word", F.array_max(F.array(*gains)).alias("best"))
    return best.where(F.col("best.gain") >= GAIN).orderBy(F.desc("best.gain"), "word").limit(features) \
        .select("word", F.col("best.domain").alias("marks"))


def traits(rows: DataFrame, model: DataFrame, *keys: str) -> DataFrame:
    """keys, n_tokens, n_rows and the traits of every different document, from 0 to TOP."""
    shares = [F.expr(f"coalesce(cast(floor({TOP} * size({x}) / nullif(size(tokens), 0)) as int), 0)").alias(k) for k, x in SHARES.items()]
    held = [*keys, "n_tokens", *SHARES]
    # the traits of a text are fixed before its words become rows
    words = rows.select(*keys, F.expr(TOKENS).alias("tokens")) \
        .select(*keys, F.size("tokens").cast("long").alias("n_tokens"), *shares, F.expr(WORDS).alias("words")) \
        .select(*held, F.posexplode_outer("words").alias("at", "word"))
    times = F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1))       # a repeated row gives its words again
    marks = [F.least(F.lit(TOP), F.count(F.when(F.col("marks") == d, 1)) / times).cast("int").alias(f"k_{d}") for d in MARKED]
    return words.join(F.broadcast(model), "word", "left").groupBy(*held).agg(times.alias("n_rows"), *marks)   # FEATURES rows


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(marking words, log prior per domain, log probability per trait, domain and value)."""
    chosen = domain_labels(labels, sample)
    # the sample is bounded by its parameter
    texts = store(doc_rows(docs).join(F.broadcast(chosen), "id").dropDuplicates(["text"]), "op6-sample")   # copies teach once
    size = {r["domain"]: r["n"] for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    model = store(marking_words(texts, size), "op6-model")
    seen = traits(texts, model, "id", "domain")
    seen = seen.select("domain", F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).alias("v")) for t in TRAITS])).alias("x")) \
        .groupBy("domain", "x.trait", "x.v").agg(F.count("*").alias("n")).collect()
    counts = {(r["trait"], r["domain"], r["v"]): r["n"] for r in seen}
    logs = {(t, d): [math.log((counts.get((t, d, v), 0) + 0.5) / (size.get(d, 0) + 0.5 * (TOP + 1))) for v in range(TOP + 1)]
            for t in TRAITS for d in DOMAINS}
    prior = [math.log((size.get(d, 0) + 1) / (sum(size.values()) + len(DOMAINS))) for d in DOMAINS]
    return model, prior, logs


def posteriors(docs: DataFrame, fitted) -> DataFrame:
    """(id, tkey, n_tokens, n_rows, p_<domain>...): one row per different document."""
    model, prior, logs = fitted
    found = traits(doc_rows(docs).withColumn("tkey", text_key()), model, "id", "tkey")
    value = lambda t, d: F.element_at(F.array(*[F.lit(x) for x in logs[t, d]]), F.col(t) + 1)
    score = [sum((value(t, d) for t in TRAITS), F.lit(p)) for d, p in zip(DOMAINS, prior)]
    odds = [F.exp(x - F.greatest(*score)) for x in score]
    whole = sum(odds[1:], odds[0])
    return found.select("id", "tkey", "n_tokens", "n_rows", *[(o / whole).alias(f"p_{d}") for o, d in zip(odds, DOMAINS)])


def rate(steps: list[list[float]], most: float | None = None) -> Column:
    """The rate after ``steps``: from 1, each step down the gradient and back to 0 at least
    (and ``most`` at most)."""
    r: Column = F.lit(1.0)
    for s in steps:
        move = sum((F.col(f"p_{d}") * F.lit(x) for d, x in zip(DOMAINS, s)), F.lit(0.0))
        r = F.greatest(F.lit(0.0), r - move)
        r = r if most is None else F.least(F.lit(float(most)), r)
    return r


def fit_rates(members: DataFrame, weights=None, repeat: float = REPEAT, rounds: int = ROUNDS,
              most: float | None = None) -> tuple[list[list[float]], list[float]]:
    """(steps, targets): the gradient steps whose fold gives every document's rate."""
    weights = weights or WEIGHTS
    def totals(r: Column) -> list[float]:
        tokens = F.col("n_rows") * F.col("n_tokens") * r
        row = members.agg(*[F.sum(tokens * F.col(f"p_{d}")).alias(d) for d in DOMAINS]).first()
        return [row[d] or 0.0 for d in DOMAINS]

    have = totals(F.lit(1.0))
    lead = max(DOMAINS, key=lambda d: weights[d])
    target_total = repeat * have[DOMAINS.index(lead)] / max(weights[lead], 1e-9)
    targets = [weights[d] * target_total for d in DOMAINS]
    steps: list[list[float]] = []
    now = have
    for _ in range(rounds):
        residual = [(x - t) / h if h > 0 else 0.0 for x, t, h in zip(now, targets, have)]
        steps.append(residual)
        before, now = now, totals(rate(steps, most))
        if all(abs(x - y) <= CLOSE * h for x, y, h in zip(before, now, have)):
            break
    return steps, targets


def mixing_rates(docs: DataFrame, labels: DataFrame, weights=None, repeat: float = REPEAT, most: float | None = None) -> DataFrame:
    """Per different document: id, tkey, n_tokens, n_rows, p_<domain>..., rate, copies.

    ``copies`` is the rate rounded up or down by a hash of the row, in proportion, so the
    totals keep their expectation.  Null and empty texts have no tokens, the prior as
    posterior and the rate that goes with it; repeated rows share a rate and count as often
    as they stand; without labels every posterior is the same; an empty table gives an
    empty result."""
    members = store(posteriors(docs, fit(docs, labels)), "op6-members")
    steps, _ = fit_rates(members, weights, repeat, most=most)
    chance = F.pmod(F.xxhash64("id", "tkey", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return members.withColumn("rate", rate(steps, most)).withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, weights=None, repeat: float = REPEAT, most: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says (not at all, once or more; with
    ``most`` = 1 never twice)."""
    rates = mixing_rates(docs, labels, weights, repeat, most).where("copies > 0") \
        .select(F.col("id").alias("_id"), F.col("tkey").alias("_tkey"), F.col("copies").alias("_copies"))
    # always by sorting: rates are as many as documents
    return with_key(docs).join(rates.hint("merge"), ["_id", "_tkey"]) \
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*own_columns(docs))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mixing_rates(docs, labels).select(as_doc_id().alias("doc_id"), "n_tokens", "n_rows", *[f"p_{d}" for d in DOMAINS], "rate", "copies")
