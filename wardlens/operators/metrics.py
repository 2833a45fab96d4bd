"""Metric definitions over de-duplicated stays.

Input is a stay DataFrame with the role columns of ``plans.bindings.STAY_COLUMNS``
(``id, start_ts, stop_ts, patient, organization, org_id, class, payer, cost,
covered, cause``), already de-duplicated by id (``bindings.stays``).

Counts take open stays, lengths of stay cannot; stays that end before they begin
have no length and are left out of every length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import day_bucket, elapsed_hours, los_capped, midnights, normalise_name, window_buckets

D = "double"


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def in_window(c, start: str | None, end: str | None):
    """Half-open window ``[start, end)``: two comparisons the parquet reader can push down."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(c) >= _ts(start))
    if end is not None:
        cond = cond & (F.col(c) < _ts(end))
    return cond


def with_flags(s: DataFrame) -> DataFrame:
    return s.withColumns({
        "is_open": F.col("stop_ts").isNull(),
        "is_reversed": F.coalesce(F.col("stop_ts") < F.col("start_ts"), F.lit(False)),
    }).withColumn("is_complete", ~F.col("is_open") & ~F.col("is_reversed"))


def scope(s: DataFrame, classes=None, start=None, end=None, on="start_ts") -> DataFrame:
    out = s
    if classes is not None:
        out = out.where(F.col("class").isin(list(classes)))
    if start is not None or end is not None:
        out = out.where(in_window(on, start, end))
    return out


# --- counts -------------------------------------------------------------------------

def admission_count(s: DataFrame, inpatient: str, start=None, end=None) -> DataFrame:
    """Distinct inpatient encounters started in the window; open stays included."""
    x = with_flags(scope(s, [inpatient], start, end))
    return x.agg(F.count("*").alias("n_admissions"), F.count_if("is_open").alias("n_open_included"))


def encounter_volume(s: DataFrame, start=None, end=None) -> DataFrame:
    return (scope(s, None, start, end).groupBy("class")
            .agg(F.count("*").alias("n_encounters")))


def patient_volume(s: DataFrame, classes=None, start=None, end=None) -> DataFrame:
    return scope(s, classes, start, end).agg(F.count_distinct("patient").alias("n_patients"))


def ed_visits(s: DataFrame, emergency: str, start=None, end=None) -> DataFrame:
    return scope(s, [emergency], start, end).agg(F.count("*").alias("n_ed_visits"))


def ed_admission_rate(s: DataFrame, emergency: str, inpatient: str, start=None, end=None,
                      within_days: int = 1) -> DataFrame:
    """Share of ED visits followed, within ``within_days`` of their start, by an
    inpatient encounter of the same patient (a semi join on patient + time range)."""
    ed = scope(s, [emergency], start, end).select("id", "patient", "start_ts")
    ip = scope(s, [inpatient]).select(F.col("patient").alias("p2"), F.col("start_ts").alias("s2"),
                                      day_bucket("start_ts", within_days).alias("b2"))
    probe = ed.withColumn("b", F.explode(window_buckets("start_ts", within_days, within_days)))
    cond = ((probe.patient == ip.p2) & (probe.b == ip.b2) & (ip.s2 >= probe.start_ts)
            & (ip.s2 <= probe.start_ts + F.expr(f"INTERVAL {int(within_days)} DAYS")))
    followed = probe.join(ip, cond, "left_semi").select("id").distinct().withColumn("f", F.lit(1))
    flagged = ed.join(followed, "id", "left")
    return flagged.agg(
        F.count("*").alias("n_ed_visits"),
        F.count("f").alias("n_admitted"),
        F.round(F.avg(F.coalesce(F.col("f").cast(D), F.lit(0.0))), 9).alias("admission_rate"))


def open_stays(s: DataFrame, classes=None, start=None, end=None) -> DataFrame:
    x = with_flags(scope(s, classes, start, end))
    return x.agg(F.count("*").alias("n_stays"),
                 F.count_if("is_open").alias("n_open"),
                 F.count_if(~F.col("is_open")).alias("n_closed"))


def reversed_stays(s: DataFrame, classes=None, start=None, end=None) -> DataFrame:
    x = with_flags(scope(s, classes, start, end))
    return x.agg(F.count_if("is_reversed").alias("n_reversed"),
                 F.count_if("is_complete").alias("n_valid"))


# --- length of stay ------------------------------------------------------------------

def los_midnights(s: DataFrame, inpatient: str, start=None, end=None) -> DataFrame:
    """Per stay: midnights crossed, capped at 365; complete and valid stays only."""
    x = with_flags(scope(s, [inpatient], start, end)).where("is_complete")
    return x.select("id", midnights("start_ts", "stop_ts").alias("midnights"),
                    los_capped("start_ts", "stop_ts").alias("los"))


def same_day_share(s: DataFrame, inpatient: str, start=None, end=None) -> DataFrame:
    x = with_flags(scope(s, [inpatient], start, end)).where("is_complete")
    return x.agg(F.count("*").alias("n_measured"),
                 F.count_if(midnights("start_ts", "stop_ts") == 0).alias("n_same_day"),
                 F.round(F.avg(F.when(midnights("start_ts", "stop_ts") == 0, 1.0).otherwise(0.0)
                               .cast(D)), 9).alias("same_day_share"))


def los_distribution(s: DataFrame, inpatient: str, start=None, end=None) -> DataFrame:
    """Mean and median, p90 and share over a week, after the cap; exclusions reported."""
    x = with_flags(scope(s, [inpatient], start, end))
    los = los_capped("start_ts", "stop_ts")
    m = F.when(F.col("is_complete"), los)
    return x.agg(
        F.count(m).alias("n_measured"),
        F.round(F.avg(m.cast(D)), 6).alias("mean_los"),
        F.round(F.percentile(m.cast(D), 0.5), 6).alias("median_los"),
        F.round(F.percentile(m.cast(D), 0.9), 6).alias("p90_los"),
        F.round(F.avg(F.when(F.col("is_complete"), F.when(los > 7, 1.0).otherwise(0.0)).cast(D)), 9)
         .alias("share_over_7"),
        F.count_if("is_open").alias("n_open_excluded"),
        F.count_if("is_reversed").alias("n_reversed_excluded"))


def los_calendar_days(s: DataFrame, inpatient: str, start=None, end=None) -> DataFrame:
    x = with_flags(scope(s, [inpatient], start, end)).where("is_complete")
    days = midnights("start_ts", "stop_ts") + 1
    return x.agg(F.count("*").alias("n_measured"),
                 F.round(F.avg(days.cast(D)), 6).alias("mean_calendar_days"),
                 F.sum(days).cast("bigint").alias("total_calendar_days"))


def los_hours(s: DataFrame, classes, start=None, end=None) -> DataFrame:
    """Elapsed clock hours per class (for ED and observation stays)."""
    from .relational import exact_percentiles
    x = with_flags(scope(s, classes, start, end)).where("is_complete") \
        .withColumn("_h", elapsed_hours("start_ts", "stop_ts"))
    g = x.groupBy("class").agg(F.count("*").alias("n_measured"), F.round(F.avg("_h"), 6).alias("mean_hours"))
    med = exact_percentiles(x, ["class"], "_h", {"median_hours": 0.5})
    return g.join(med, "class")


def observation_stay(s: DataFrame, observation_classes, start=None, end=None) -> DataFrame:
    """Observation stays are outpatient: counted in hours, never as admissions."""
    x = with_flags(scope(s, observation_classes, start, end))
    h = F.when(F.col("is_complete"), elapsed_hours("start_ts", "stop_ts"))
    return x.agg(F.count("*").alias("n_observation_stays"),
                 F.count(h).alias("n_measured"),
                 F.round(F.sum(h), 6).alias("total_hours"),
                 F.round(F.avg(h), 6).alias("mean_hours"))


def bed_days(s: DataFrame, inpatient: str, start: str, end: str, as_of: str) -> DataFrame:
    """Occupied bed-days in ``[start, end)``: midnights clipped to the period, open
    stays counted up to ``as_of``, no cap, reversed stays excluded."""
    x = with_flags(scope(s, [inpatient])).where(~F.col("is_reversed"))
    eff_stop = F.coalesce(F.col("stop_ts"), _ts(as_of))
    lo = F.greatest(F.to_date("start_ts"), F.to_date(_ts(start)))
    hi = F.least(F.to_date(eff_stop), F.to_date(_ts(end)))
    days = F.greatest(F.datediff(hi, lo), F.lit(0))
    x = x.where((F.col("start_ts") < _ts(end)) & (eff_stop > _ts(start)))
    return x.groupBy("organization").agg(
        F.sum(days).cast("bigint").alias("bed_days"),
        F.count("*").alias("n_stays"),
        F.count_if("is_open").alias("n_open_included"))


def occupancy_rate(s: DataFrame, capacity: DataFrame, inpatient: str, start: str, end: str,
                   as_of: str) -> DataFrame:
    """bed-days / (staffed beds x days); ``capacity`` has ``organization, staffed_beds``."""
    bd = bed_days(s, inpatient, start, end, as_of)
    n_days = F.datediff(F.to_date(_ts(end)), F.to_date(_ts(start)))
    return (bd.join(capacity, "organization")
              .select("organization", "bed_days", "staffed_beds",
                      n_days.alias("days_in_period"),
                      F.round(F.col("bed_days").cast(D) / (F.col("staffed_beds") * n_days), 9)
                       .alias("occupancy_rate")))


# --- transfers, disposition, readmission ------------------------------------------

def transfer_pairs(s: DataFrame, inpatient: str, gap_days: int = 1) -> DataFrame:
    """Stay ending at one organisation as another begins for the same patient within
    ``gap_days``: an equi join on patient plus a time-range residual."""
    a = with_flags(scope(s, [inpatient])).where("is_complete").select(
        F.col("id").alias("from_id"), F.col("patient"), F.col("organization").alias("from_org"),
        F.col("stop_ts").alias("from_stop"), F.explode(window_buckets("stop_ts", gap_days, gap_days)).alias("b"))
    b = with_flags(scope(s, [inpatient])).where(~F.col("is_reversed")).select(
        F.col("id").alias("to_id"), F.col("patient").alias("p2"), F.col("organization").alias("to_org"),
        F.col("start_ts").alias("to_start"), day_bucket("start_ts", gap_days).alias("b2"))
    cond = ((a.patient == b.p2) & (a.b == b.b2) & (a.from_org != b.to_org) & (b.to_start >= a.from_stop)
            & (b.to_start <= a.from_stop + F.expr(f"INTERVAL {int(gap_days)} DAYS"))
            & (a.from_id != b.to_id))
    # a pair lies in exactly one bucket of the target's start, so no duplicates arise
    return a.join(b, cond).select("from_id", "to_id", "patient", "from_org", "to_org")


def first_death(deaths: DataFrame) -> DataFrame:
    """(patient, death_ts), one row per patient, so that no stay is repeated."""
    return deaths.groupBy("patient").agg(F.min("death_ts").alias("death_ts"))


def stored_stays(s: DataFrame, inpatient: str) -> DataFrame:
    """The stays of a class, written once for the several uses that follow."""
    from ..sources.files import materialise
    return materialise(scope(s, [inpatient]).select("id", "patient", "class", "organization", "cause", "start_ts", "stop_ts"), "stays")


def discharge_disposition(s: DataFrame, inpatient: str, start=None, end=None,
                          deaths: DataFrame | None = None, gap_days: int = 1, against_advice: DataFrame | None = None) -> DataFrame:
    """Inferred disposition: open, invalid, death (the patient died during the stay; needs
    ``deaths``: patient, death_ts), against_advice (needs the ids of such stays), transfer
    (adjacency), home.  A disposition that cannot be told for want of its table has a row
    whose count is null, so that its absence is not read as zero."""
    s = stored_stays(s, inpatient)
    x = with_flags(scope(s, [inpatient], start, end, on="stop_ts") if start or end
                   else scope(s, [inpatient]))
    if start or end:
        x = x.unionByName(with_flags(scope(s, [inpatient])).where("is_open"))
    tr = transfer_pairs(s, inpatient, gap_days).select(F.col("from_id").alias("id")).distinct() \
        .withColumn("_tr", F.lit(True))
    x = x.join(tr, "id", "left")
    died = F.lit(False)
    if deaths is not None:
        x = x.join(first_death(deaths), "patient", "left")
        died = F.coalesce((F.col("death_ts") >= F.col("start_ts"))
                          & (F.col("death_ts") <= F.col("stop_ts")), F.lit(False))
    x = flagged_ids(x, against_advice, "_left")
    disp = (F.when(F.col("is_open"), "open").when(F.col("is_reversed"), "invalid")
            .when(died, "death").when(F.col("_left"), "against_advice").when(F.col("_tr").isNotNull(), "transfer").otherwise("home"))
    out = x.groupBy(disp.alias("disposition")).agg(F.count("*").alias("n_stays"))
    unknown = [(name,) for name, given in (("death", deaths), ("against_advice", against_advice)) if given is None]
    if not unknown:
        return out
    return out.unionByName(s.sparkSession.createDataFrame(unknown, "disposition string").withColumn("n_stays", F.lit(None).cast("bigint")))


def flagged_ids(x: DataFrame, ids: DataFrame | None, flag: str) -> DataFrame:
    """``x`` with whether its ``id`` is in ``ids`` (id); false everywhere if there is no such table."""
    if ids is None:
        return x.withColumn(flag, F.lit(False))
    return x.join(ids.select("id").distinct().withColumn(flag, F.lit(True)), "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def readmission_flags(s: DataFrame, inpatient: str, start: str, end: str, window_days: int = 30,
                      anchor: str = "discharge", same_facility: bool = False,
                      same_cause: bool = False, exclude_transfers: bool = False,
                      transfer_gap_days: int = 1, deaths: DataFrame | None = None,
                      against_advice: DataFrame | None = None, planned: DataFrame | None = None,
                      codes: DataFrame | None = None) -> DataFrame:
    """One row per inpatient index candidate discharged in ``[start, end)`` with its
    exclusion flags and ``readmitted`` (any later inpatient start of the same patient
    in ``(anchor, anchor + window]``; counted once per index).

    deaths: patient, death_ts; against_advice, planned: ids of stays (those leave the index,
    these do not count as a return); codes: id, code.  ``same_cause`` asks for a common
    code: the codes of a stay are keys of the join beside patient and time, so a stay
    meets only stays that share one; without ``codes`` the column ``cause`` is the code."""
    s = stored_stays(s, inpatient)
    base = with_flags(s)
    idx = base.where(in_window("stop_ts", start, end) | F.col("is_open"))
    anchor_col = F.col("stop_ts") if anchor == "discharge" else F.col("start_ts")
    idx = idx.withColumn("anchor_ts", anchor_col)
    tail_cut = _ts(end) - F.expr(f"INTERVAL {int(window_days)} DAYS")
    idx = idx.withColumns({
        "x_open": F.col("is_open"),
        "x_reversed": F.col("is_reversed"),
        "x_tail": F.coalesce(F.col("stop_ts") > tail_cut, F.lit(False)),
    })
    if exclude_transfers:
        tr = transfer_pairs(s, inpatient, transfer_gap_days).select(F.col("from_id").alias("id")) \
            .distinct().withColumn("x_transfer", F.lit(True))
        idx = idx.join(tr, "id", "left").withColumn("x_transfer", F.coalesce("x_transfer", F.lit(False)))
    else:
        idx = idx.withColumn("x_transfer", F.lit(False))
    if deaths is not None:
        idx = idx.join(first_death(deaths), "patient", "left").withColumn(
            "x_death", F.coalesce(F.col("death_ts") <= F.col("stop_ts"), F.lit(False))).drop("death_ts")
    else:
        idx = idx.withColumn("x_death", F.lit(False))
    idx = flagged_ids(idx, against_advice, "x_against_advice")
    idx = idx.withColumn("eligible", ~(F.col("x_open") | F.col("x_reversed") | F.col("x_tail")
                                       | F.col("x_transfer") | F.col("x_death") | F.col("x_against_advice")))
    # Follow-ups: open stays count (they started); reversed stays do not.
    returns = flagged_ids(base.where(~F.col("is_reversed")), planned, "_planned").where(~F.col("_planned"))
    if same_cause:
        codes = (base.select("id", F.col("cause").alias("code")) if codes is None else codes.select("id", "code")).where("code is not null").distinct()
        returns = returns.join(codes.withColumnRenamed("code", "fu_code"), "id")
    fu = returns.select(
        *(["fu_code"] if same_cause else []), F.col("id").alias("fu_id"), F.col("patient").alias("fu_patient"),
        F.col("start_ts").alias("fu_start"), F.col("organization").alias("fu_org"),
        day_bucket("start_ts", window_days).alias("fu_b"))
    # equi-key (patient, day bucket): a patient's stays only meet follow-ups near in time
    e = idx.where("eligible").withColumn("_b", F.explode(window_buckets("anchor_ts", window_days, window_days)))
    cond = ((e.patient == fu.fu_patient) & (e._b == fu.fu_b) & (fu.fu_id != e.id) & (fu.fu_start > e.anchor_ts)
            & (fu.fu_start <= e.anchor_ts + F.expr(f"INTERVAL {int(window_days)} DAYS")))
    if same_facility:
        cond = cond & (fu.fu_org == e.organization)
    if same_cause:
        e = e.join(codes, "id")
        cond = (F.col("patient") == F.col("fu_patient")) & (F.col("code") == F.col("fu_code")) & (F.col("_b") == F.col("fu_b")) \
            & (F.col("fu_id") != F.col("id")) & (F.col("fu_start") > F.col("anchor_ts")) \
            & (F.col("fu_start") <= F.col("anchor_ts") + F.expr(f"INTERVAL {int(window_days)} DAYS"))
        if same_facility:
            cond = cond & (F.col("fu_org") == F.col("organization"))
    hit = e.join(fu, cond, "left_semi").select("id").distinct().withColumn("readmitted", F.lit(True))
    return (idx.join(hit, "id", "left")
               .withColumn("readmitted", F.coalesce("readmitted", F.lit(False)) & F.col("eligible")))


def _rate_aggs():
    return [F.count_if("eligible").alias("n_eligible"),
            F.count_if("readmitted").alias("n_readmitted"),
            F.round(F.try_divide(F.count_if("readmitted").cast(D), F.count_if("eligible").cast(D)), 9)
             .alias("readmission_rate")]


def readmission_rate(s: DataFrame, inpatient: str, start: str, end: str, **kw) -> DataFrame:
    f = readmission_flags(s, inpatient, start, end, **kw)
    return f.agg(*_rate_aggs(), F.count_if("x_tail").alias("n_tail_excluded"))


def readmission_by_org(s: DataFrame, inpatient: str, start: str, end: str, **kw) -> DataFrame:
    """Rate per facility, charged to the index stay's organisation."""
    f = readmission_flags(s, inpatient, start, end, **kw)
    return f.groupBy("organization").agg(*_rate_aggs())


def exclusion_report(s: DataFrame, inpatient: str, start: str, end: str, **kw) -> DataFrame:
    f = readmission_flags(s, inpatient, start, end, **kw)
    return f.agg(F.count("*").alias("n_candidates"),
                 F.count_if("x_open").alias("n_open"),
                 F.count_if("x_reversed").alias("n_reversed"),
                 F.count_if("x_tail").alias("n_unobservable_tail"),
                 F.count_if("x_transfer").alias("n_transfer"),
                 F.count_if("x_death").alias("n_death"),
                 F.count_if("x_against_advice").alias("n_against_advice"),
                 F.count_if("eligible").alias("n_eligible"),
                 F.lit(unavailable_rules(**kw)).alias("unavailable"))


def unavailable_rules(**kw) -> str:
    """The exclusions that cannot be applied for want of their table, by name."""
    given = {"death": kw.get("deaths"), "against_advice": kw.get("against_advice"), "planned": kw.get("planned")}
    return ",".join(name for name, table in given.items() if table is None)


# --- attribution, identity, payer mix ------------------------------------------------

def provider_volume(s: DataFrame, provider_col: str = "org_id", classes=None, start=None,
                    end=None) -> DataFrame:
    return (scope(s, classes, start, end).groupBy(F.col(provider_col).alias("provider"))
            .agg(F.count("*").alias("n_encounters")))


def org_volume_ranking(s: DataFrame, orgs: DataFrame, inpatient: str, start=None, end=None,
                       top_n: int = 10) -> DataFrame:
    """Top organisations by identity (name + city), not by id; ties broken by name, city."""
    x = scope(s, [inpatient], start, end).select("id", "org_id")
    j = x.join(orgs.select(F.col("org_key").alias("org_id"), "name", "city"), "org_id")
    g = j.groupBy("name", "city").agg(F.count("*").alias("n_encounters"))
    w = Window.orderBy(F.desc("n_encounters"), F.asc("name"), F.asc("city"))
    return g.orderBy(F.desc("n_encounters"), "name", "city").limit(top_n) \
        .withColumn("rank", F.row_number().over(w))


def org_identity(orgs: DataFrame) -> DataFrame:
    """Identity of each organisation id: (name, city), with the ids sharing it
    (one aggregate per identity joined back, no window over a hot identity)."""
    g = orgs.groupBy("name", "city").agg(F.count("*").alias("ids_with_identity"),
                                         F.min("org_key").alias("identity_key"))
    return orgs.select("org_key", "name", "city").join(g, ["name", "city"])


def health_system_rollup(s: DataFrame, facility_to_system: DataFrame, start=None, end=None,
                         classes=None) -> DataFrame:
    """Facilities to parent systems through an explicit mapping; unmapped kept."""
    x = scope(s, classes, start, end).select("id", "org_id")
    j = x.join(facility_to_system, "org_id", "left")
    return j.groupBy(F.coalesce(F.col("system"), F.lit("unmapped")).alias("system")) \
        .agg(F.count("*").alias("n_encounters"),
             F.count_distinct("org_id").alias("n_facilities"))


def patient_dedup(patients: DataFrame, s: DataFrame) -> DataFrame:
    """Exact stable key -> canonical patient (smallest id); facts re-keyed to it."""
    keyed = patients.groupBy("person_key").agg(F.min("patient").alias("canonical_patient"))
    canon = patients.join(keyed, "person_key").select("patient", "canonical_patient")
    j = s.select("id", "patient").join(canon, "patient", "left")
    return j.groupBy(F.coalesce("canonical_patient", "patient").alias("canonical_patient")) \
        .agg(F.count_distinct("patient").alias("n_source_ids"),
             F.count("*").alias("n_encounters"))


def payer_normalise(payers: DataFrame) -> DataFrame:
    """Normalised key per payer id, one display spelling per key (smallest raw name)."""
    k = payers.select("payer_id", "name", normalise_name("name").alias("payer_key"))
    disp = k.groupBy("payer_key").agg(F.min("name").alias("display_name"),
                                      F.count("*").alias("ids_with_key"))
    return k.join(disp, "payer_key").select("payer_id", "name", "payer_key", "display_name",
                                            "ids_with_key")


def payer_mix_encounters(s: DataFrame, payers: DataFrame | None, classes=None, start=None,
                         end=None) -> DataFrame:
    """Distinct encounters per normalised payer over all in scope; no-payer kept as
    ``uninsured``; the denominator is stated on every row."""
    x = scope(s, classes, start, end).select("id", "payer")
    if payers is not None:
        x = x.join(payers.select(F.col("payer_id").alias("payer"), "name"), "payer", "left")
        key = F.coalesce(normalise_name("name"), F.lit("uninsured"))
    else:
        key = F.coalesce(normalise_name("payer"), F.lit("uninsured"))
    return _share_of_total(x.withColumn("payer_key", key), "id", "n_encounters")


def payer_mix_patients(s: DataFrame, classes=None, start=None, end=None) -> DataFrame:
    """Distinct patients per payer over distinct patients in scope (shares may exceed 1)."""
    x = scope(s, classes, start, end).select("patient", "payer")
    key = F.coalesce(normalise_name("payer"), F.lit("uninsured"))
    return _share_of_total(x.withColumn("payer_key", key), "patient", "n_patients")


def _share_of_total(x: DataFrame, counted: str, name: str) -> DataFrame:
    """``counted`` per payer key and over the whole scope.  Stays are one row per id, so
    they are counted; patients are counted once each per key and once over all (one
    rollup).  The total is a scalar subquery over the grouped result."""
    if counted == "id":
        r = x.groupBy("payer_key").agg(F.count("*").alias(name))
        total = r.agg(F.sum(name)).scalar()
    else:
        g = x.rollup("payer_key").agg(F.count_distinct(counted).alias(name), F.grouping_id().alias("_g"))
        r, total = g.where("_g = 0").drop("_g"), g.where("_g = 1").select(name).scalar()
    return r.withColumn("denominator", total).withColumn("share", F.round(F.col(name).cast(D) / F.col("denominator"), 9))


def covered_months(cov: DataFrame, start: str, end: str) -> DataFrame:
    """Of every coverage span ``patient, payer, from_ts, to_ts`` (an open one runs to
    ``end``) the first and last month inside the period, as month numbers, and how many of
    its months no earlier span of the patient and payer covers: spans are taken in order
    of their first month, so only months after the latest so far are new."""
    from .relational import prior_max_within
    lo = F.greatest(F.trunc(F.to_date("from_ts"), "month"), F.to_date(_ts(start)))
    until = F.coalesce(F.col("to_ts"), _ts(end))
    hi = F.to_date(F.least(until, _ts(end)))
    month = lambda d: (F.year(d) * 12 + F.month(d)).cast("int")
    spans = cov.where((F.col("from_ts") < _ts(end)) & (until > _ts(start)) & (hi > lo)) \
        .select("patient", "payer", month(lo).alias("first"), month(F.date_sub(hi, 1)).alias("last"))
    held = prior_max_within(spans, ["patient", "payer"], ["first", "last"], "last", "seen")
    new = F.col("last") - F.greatest(F.col("first") - 1, F.coalesce("seen", F.col("first") - 1))
    return held.withColumn("new_months", F.greatest(new, F.lit(0)))


def payer_mix_member_months(cov: DataFrame, start: str, end: str) -> DataFrame:
    """Covered member-months per payer: the union of each patient's spans, counted by month
    arithmetic (``covered_months``), so no row is made for a month."""
    return covered_months(cov, start, end).groupBy("payer").agg(
        F.sum("new_months").cast("bigint").alias("member_months"), F.count_distinct("patient").alias("n_members"))


def coverage_rate(s: DataFrame, classes=None, start=None, end=None) -> DataFrame:
    """sum(covered) / sum(cost) per payer: a ratio of sums, zero/NULL costs dropped."""
    x = scope(s, classes, start, end).where(F.col("cost").isNotNull() & (F.col("cost") != 0))
    return x.groupBy("payer").agg(
        F.round(F.sum("covered") / F.sum("cost"), 9).alias("coverage_rate"),
        F.count("*").alias("n_encounters"))
