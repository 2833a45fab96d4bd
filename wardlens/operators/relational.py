"""Relational core: the projection, filter, join, aggregate, window, sort and set
shapes the reference's queries use, as small DataFrame functions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import RESULT_ROW_CAP, hash_order_key


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- projections and filters ----------------------------------------------------------

def project_replace(df: DataFrame, replacements: dict[str, Column]) -> DataFrame:
    """Literal / derived columns in place of some columns, every other column kept."""
    return df.withColumns(replacements)


def project_explicit_copy(df: DataFrame, id_col: str, new_id: Column) -> DataFrame:
    """A copy of the rows under a new id, every column named explicitly."""
    return df.select(*[(new_id.alias(c) if c == id_col else F.col(c)) for c in df.columns])


def year_window(c: str, year: int) -> Column:
    """``year(c) = y`` rewritten as a half-open range so the scan can prune on it."""
    lo = F.lit(f"{year}-01-01").cast("timestamp_ntz")
    hi = F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")
    return (F.col(c) >= lo) & (F.col(c) < hi)


def filter_in(df: DataFrame, key: str, sub: DataFrame, sub_key: str) -> DataFrame:
    """``key IN (SELECT sub_key ...)`` as a left semi join."""
    return df.join(sub.select(F.col(sub_key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def filter_not_in(df: DataFrame, key: str, sub: DataFrame, sub_key: str) -> DataFrame:
    """``key NOT IN (SELECT ...)`` as a left anti join; keys are asserted non-null,
    because SQL NOT IN with a NULL in the list returns no row at all."""
    s = sub.select(F.col(sub_key).alias("_k")).where(F.col("_k").isNotNull())
    return df.where(F.col(key).isNotNull()).join(s, F.col(key) == F.col("_k"), "left_anti")


def conditional_update(df: DataFrame, column: str, value: Column, cond: Column) -> DataFrame:
    """``UPDATE t SET column = value WHERE cond`` as a new snapshot."""
    return df.withColumn(column, F.when(cond, value).otherwise(F.col(column)))


# --- aggregates ------------------------------------------------------------------------

def having_count(df: DataFrame, keys, min_count: int = 2) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def share_of_total(grouped: DataFrame, count_col: str, out: str = "share") -> DataFrame:
    """Group count over the grand total, on an already-grouped (small) result."""
    tot = F.sum(count_col).over(Window.partitionBy())
    return grouped.withColumn(out, F.round(F.col(count_col).cast("double") / tot, 9))


# --- windows ---------------------------------------------------------------------------

def dedupe_by(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first under ``order`` (column names, ascending, NULLs
    last), i.e. ``row_number() = 1`` over the key.  Evaluated as a map-side-combined
    ``min(struct)`` aggregation so a hot key is never gathered in one task."""
    from ..plans.bindings import dedupe_min
    return dedupe_min(df, keys, tuple(order))


def step_order(df: DataFrame, run: str, order) -> DataFrame:
    """Steps numbered 1.. per run (skew-safe ``row_number``)."""
    return ranked_within(df, [run], order, rank_col="step")


def repeats(df: DataFrame, run: str, key_cols, order) -> DataFrame:
    """Every occurrence after the first of the same key inside a run."""
    return ranked_within(df, [run, *key_cols], order, rank_col="occurrence").where("occurrence > 1")


def loop_window(df: DataFrame, run: str, key_cols, step: str, width: int) -> DataFrame:
    """How many of the previous ``width`` steps of the run repeat this step's key."""
    return repeats_in_previous(df, run, key_cols, step, width)


# --- sorts, limits, samples ----------------------------------------------------------------

def top1(df: DataFrame, count_col: str, key: str) -> DataFrame:
    """The busiest key, ties broken by the key (a one-row DataFrame, never collected)."""
    return df.orderBy(F.desc(count_col), F.asc_nulls_last(key)).limit(1)


def hash_ordered_sample(df: DataFrame, id_col: str, seed, n: int) -> DataFrame:
    """Exact-size repeatable sample: order by md5(id | seed), then id; keep n."""
    return df.orderBy(hash_order_key(id_col, seed), F.col(id_col)).limit(n)


def total_order(df: DataFrame):
    return [F.col(f"`{c}`").asc_nulls_last() for c in df.columns]


def ordered_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """n rows under a total order over all columns, NULLs last (as in the oracle)."""
    return df.orderBy(*total_order(df)).limit(n)


def limit_clamp(df: DataFrame, asked: int, cap: int = RESULT_ROW_CAP) -> DataFrame:
    """LIMIT forced to ``min(asked, cap)``, at least 1."""
    return df.limit(max(1, min(int(asked), cap)))


# --- set operations -------------------------------------------------------------------

def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def pairwise_overlap(flags: DataFrame, names) -> DataFrame:
    """Sizes of intersections of every pair of id sets, from ONE aggregation over a
    one-row-per-id flag table (no set is ever collected)."""
    pairs = list(combinations(names, 2))
    agg = flags.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}__{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return agg.selectExpr(f"stack({len(pairs)}, {stack}) AS (set_a, set_b, n_both)")


def result_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference both ways, tagged with the side the rows are missing from."""
    return (a.exceptAll(b).withColumn("only_in", F.lit("left"))
            .unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right"))))


def _pin(df: DataFrame, name: str) -> DataFrame:
    """Row ids that encode the sorted partition are layout-dependent: store them once
    so the offset table and the rows it is joined back to agree."""
    from ..sources.files import materialise
    return materialise(df, name)


def exact_percentiles(df: DataFrame, keys, value: str, probs: dict[str, float], digits: int = 6) -> DataFrame:
    """Exact interpolated percentiles per group (``quantile_cont`` semantics) without
    ever buffering a group in one task.

    1. a range-partitioned sort by (keys, value): a hot group spans many partitions;
    2. per (group, partition) counts -> each partition's rank offset inside its group
       (a small table: at most groups + partitions rows);
    3. the rows at the two ranks around ``p * (n - 1)`` are addressed directly: after
       the sort, ``monotonically_increasing_id`` is (partition << 33) + position, and
       a group's rows in a partition are contiguous, so the rank maps to one id;
    4. those few rows are fetched with an equi-join on the id and interpolated.

    The sorted, id-stamped rows are written once (``_pin``) so both uses agree.
    """
    keys = list(keys)
    x = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    order = [F.col(k).asc_nulls_last() for k in keys] + [F.col("_v")]
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an explicit partition count: AQE leaves it alone, so every read of the sorted
    # rows sees the same partitions and ids
    srt = x.repartitionByRange(n_parts, *order).sortWithinPartitions(*order) \
        .withColumn("_mid", F.monotonically_increasing_id())
    srt = _pin(srt.withColumn("_pid", F.shiftright("_mid", 33)), "percentile-sorted")
    part = srt.groupBy(*keys, "_pid").agg(F.count("*").alias("_c"), F.min("_mid").alias("_m0"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))) \
        .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    # target ranks: for every probability the floor and ceiling of p * (n - 1)
    tk = [f"_tk{i}" for i in range(len(keys))]
    tg = part.select(*[F.col(k).alias(t) for k, t in zip(keys, tk)], "_n").distinct().select(
        *tk, "_n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"))
                                       for name, p in probs.items()])).alias("t"))
    tg = tg.select(*tk, "t.name", (F.col("t.p") * (F.col("_n") - 1)).alias("_pos"))
    tg = tg.select(*tk, "name", "_pos", F.explode(F.array_distinct(F.array(
        F.floor("_pos"), F.ceil("_pos")))).alias("_rank"))
    pr = part.select(*[F.col(k).alias(f"_pk{i}") for i, k in enumerate(keys)], "_off", "_c", "_m0")
    cond = [F.col(t).eqNullSafe(F.col(f"_pk{i}")) for i, t in enumerate(tk)] + [
        F.col("_rank") >= F.col("_off"), F.col("_rank") < F.col("_off") + F.col("_c")]
    loc = tg.join(pr, cond).select(*[F.col(t).alias(k) for t, k in zip(tk, keys)], "name", "_pos", "_rank",
                                   (F.col("_m0") + F.col("_rank") - F.col("_off")).alias("_mid"))
    vals = loc.join(srt.select("_mid", "_v"), "_mid")
    g = vals.groupBy(*keys, "name", "_pos").agg(
        F.min_by("_v", "_rank").alias("_lo"), F.max_by("_v", "_rank").alias("_hi"))
    res = g.select(*keys, "name", F.round(F.col("_lo") + (F.col("_pos") - F.floor("_pos")) * (F.col("_hi") - F.col("_lo")),
                                          digits).alias("q"))
    return res.groupBy(*keys).pivot("name", list(probs)).agg(F.first("q"))


def ranked_within(df: DataFrame, keys, order, sum_col: str | None = None, rank_col: str = "_rank",
                  cum_col: str = "_cum") -> DataFrame:
    """``row_number()`` over (keys ordered by ``order``), and optionally the sum of
    ``sum_col`` over the strictly preceding rows, without gathering a group in one
    task: a range-partitioned sort spreads a hot group over many partitions; per
    (group, partition) counts and sums give each partition's offsets (a small
    table); a row's rank is its partition offset plus its position, which
    ``monotonically_increasing_id`` encodes after the sort (the sorted, id-stamped
    rows are written once so offsets and rows agree).  ``order`` must make the order
    total inside a group."""
    keys, order = list(keys), list(order)
    cols = df.columns
    by = [F.col(k).asc_nulls_last() for k in keys] + [F.col(c).asc_nulls_last() for c in order]
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    srt = df.repartitionByRange(n_parts, *by).sortWithinPartitions(*by) \
        .withColumn("_mid", F.monotonically_increasing_id())
    srt = _pin(srt.withColumn("_pid", F.shiftright("_mid", 33)), "ranked-sorted")
    aggs = [F.count("*").alias("_c"), F.min("_mid").alias("_m0")]
    if sum_col:
        aggs.append(F.sum(sum_col).alias("_s"))
    part = srt.groupBy(*keys, "_pid").agg(*aggs)
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    if sum_col:
        part = part.withColumn("_soff", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    pk = [f"_pk{i}" for i in range(len(keys))]
    pr = part.select(*[F.col(k).alias(p) for k, p in zip(keys, pk)], F.col("_pid").alias("_ppid"), "_off", "_m0",
                     *(["_soff"] if sum_col else []))
    cond = [F.col(k).eqNullSafe(F.col(p)) for k, p in zip(keys, pk)] + [F.col("_pid") == F.col("_ppid")]
    j = srt.join(pr, cond).withColumn(rank_col, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("int"))
    out = [*cols, rank_col]
    if sum_col:
        # running sum inside one (group, partition): bounded by the partition size
        w = Window.partitionBy(*keys, "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
        j = j.withColumn(cum_col, F.col("_soff") + F.coalesce(F.sum(sum_col).over(w), F.lit(0)))
        out.append(cum_col)
    return j.select(*out)


def prior_max_within(df: DataFrame, keys, order, value: str, out: str) -> DataFrame:
    """``df`` with the largest ``value`` among the rows that stand before in the group
    (``keys``, in ``order``); null for the first.  A range-partitioned sort spreads a hot
    group over many partitions; a running maximum answers inside a partition, and what
    the earlier partitions of the group hold comes from one row for each of them."""
    keys, order = list(keys), list(order)
    by = [F.col(k).asc_nulls_last() for k in [*keys, *order]]
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    srt = df.repartitionByRange(n_parts, *by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id())
    srt = _pin(srt.withColumn("_pid", F.shiftright("_mid", 33)), "prior-max-sorted")
    tops = srt.groupBy(*keys, "_pid").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), F.max("_top").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    held = srt.withColumn("_in", F.max(value).over(inside))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_pid") == F.col("_p")]
    return held.join(carry, on).select(*df.columns, F.greatest("_in", "_carry").alias(out))


def as_of(rows: DataFrame, time: str, history: DataFrame, since: str, values) -> DataFrame:
    """``rows`` with the value of each of ``values`` that ``history`` held at ``time``: that
    of the newest entry (``since`` <= ``time``) in which it is not null; of entries of one
    time the greatest.  Null where nothing was held yet, or ``time`` is null.

    Rows and entries are sorted together by time into range partitions and stored; inside
    a partition a running last value answers, and what stands before a partition comes
    from one row for each of them.  So no window holds all rows, and no row meets an
    entry but the newest."""
    values = list(values)
    left = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.col(time).alias("_time"), F.lit(1).alias("_kind"),
                       *[F.lit(None).cast(history.schema[v].dataType).alias(f"_v_{v}") for v in values])
    right = history.where(F.col(since).isNotNull()).groupBy(F.col(since).alias("_time")).agg(*[F.max(v).alias(f"_v_{v}") for v in values]).select(
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_time", F.lit(0).alias("_kind"), *[f"_v_{v}" for v in values])
    # the last key only spreads rows of one time over partitions
    joint = right.unionByName(left).withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in ("_time", "_kind", "_tie")]
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    srt = joint.repartitionByRange(n_parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    srt = _pin(srt.withColumn("_pid", F.shiftright("_at", 33)), "as-of-sorted")
    ends = srt.groupBy("_pid").agg(*[F.max_by(f"_v_{v}", F.when(F.col(f"_v_{v}").isNotNull(), F.col("_at"))).alias(f"_e_{v}") for v in values])
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)     # one row a partition
    carried = ends.select("_pid", *[F.last(f"_e_{v}", ignorenulls=True).over(earlier).alias(f"_c_{v}") for v in values])
    inside = Window.partitionBy("_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    held = srt.select("_row", "_kind", "_time", "_pid", *[F.last(f"_v_{v}", ignorenulls=True).over(inside).alias(f"_h_{v}") for v in values])
    out = held.where("_kind = 1").join(carried, "_pid", "left")
    return out.select("_row.*", *[F.when(F.col("_time").isNotNull(), F.coalesce(f"_h_{v}", f"_c_{v}")).alias(v) for v in values])


def repeats_in_previous(df: DataFrame, run: str, key_cols, step: str, width: int,
                        out: str = "repeats_in_window") -> DataFrame:
    """For each row, how many of the previous ``width`` steps of its run carry the
    same key.  Steps are consecutive integers per run, so each row probes the exact
    (run, key, step - d) rows with an equi-join on a unique key: no window over a
    run, no pair explosion inside a hot key."""
    key_cols = list(key_cols)
    probes = df.select(run, *key_cols, step, F.explode(F.sequence(F.col(step) - width, F.col(step) - 1))
                       .alias("_prev"))
    targets = df.select(F.col(run).alias("_r"), *[F.col(k).alias(f"_t_{k}") for k in key_cols],
                        F.col(step).alias("_s"))
    cond = [probes[run].eqNullSafe(targets["_r"]), probes["_prev"] == targets["_s"]] + \
        [probes[k].eqNullSafe(targets[f"_t_{k}"]) for k in key_cols]
    hits = probes.join(targets, cond).groupBy(run, step).agg(F.count("*").alias(out))
    return df.join(hits, [run, step], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))
