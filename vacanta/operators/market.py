"""Market operators (M-01..M-17) and the market/seeker/finance predicates (F-*).

All read the deduplicated postings (W-01) unless noted. Month windows are
computed on the distinct months of the filtered data -- a calendar-bounded
table (12 rows a year), so joining it back by broadcast has a proven bound.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.clean import first_of_group, in_bounded_tasks
from ..functions.quantile import with_exact_median
from ..functions.expr import all_of, month_key, null_safe_corr, scalar

# ---- fixed values ------------------------------------------------------------
ENGAGEMENT_COUNTER_FREEZE_DATE = "2023-07-01"
WAGE_DECOMPOSITION_START_DATE = "2023-03-01"
MIN_SEGMENT_SIZE = 50
MIN_LEVERAGE_SAMPLE = 2000
MIN_CONTRACT_COHORT_SAMPLE = 30
MIN_REPOST_SAMPLE = 30
MIN_SECTORS_FOR_CORRELATION = 5
AGENCY_NAME_PATTERN = (r"RECRUIT|STAFFING|MANPOWER|\bHR\b|HUMAN RESOURCE|TALENT|CONSULTANC|"
                       r"EMPLOYMENT|OUTSOURC|HEADHUNT|PLACEMENT|ADVISORY")
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# ------------------------------------------------------------------------------


def dedup_first_seen(jobs: DataFrame, group: str = "dup_group_id",
                     order=("posting_date", "job_id")) -> DataFrame:
    """W-01: one row per duplicate group, the first by ``order`` (nulls last).

    Uses the cleaning stage's ``is_first_seen`` flag when the frame carries it
    (a pushed-down filter); on a fact stored under the column contract it
    aggregates the first member per group -- map-side partially aggregated,
    so a hot group is never gathered in one task -- and keeps it with a
    semi join on the member's place; rows without a group form one."""
    if "is_first_seen" in jobs.columns:
        return jobs.where(F.col("is_first_seen"))
    placed, rank, place = first_of_group(jobs, *order)
    firsts = in_bounded_tasks(placed, group, rank).groupBy(group).agg(F.min("_order").getField("place").alias(place))
    return placed.join(firsts, place, "left_semi").drop(place)


def market_filter(sector: str | None = None, position_level: str | None = None) -> Column:
    """F-01: posting_date present, optional sector and level equality."""
    conds = [F.col("posting_date").isNotNull()]
    if sector:
        conds.append(F.col("sector") == F.lit(sector))
    if position_level:
        conds.append(F.col("position_level") == F.lit(position_level))
    return all_of(conds)


def ramp_filter(sector=None, position_level=None, start: str = WAGE_DECOMPOSITION_START_DATE) -> Column:
    """F-02: market filter plus the onboarding ramp excluded."""
    return market_filter(sector, position_level) & (F.col("posting_date") >= F.to_date(F.lit(start)))


def level_filter(position_level: str | None) -> Column:
    """F-06: optional position level."""
    return F.col("position_level") == F.lit(position_level) if position_level else F.lit(True)


def ok_pay() -> Column:
    """(min + max) / 2 on rows flagged 'ok', null elsewhere."""
    return F.when(F.col("salary_flag") == "ok", (F.col("salary_min") + F.col("salary_max")) / 2.0)


def headline(deduped: DataFrame, sector=None, position_level=None) -> DataFrame:
    """M-01: posting count and rounded median ok-pay."""
    return (deduped.where(market_filter(sector, position_level))
            .agg(F.count(F.lit(1)).alias("total_postings"),
                 F.round(F.median(ok_pay())).alias("median_pay")))


def industry_ranking(deduped: DataFrame, sector=None, position_level=None, limit: int | None = None) -> DataFrame:
    """M-02: postings per sector, descending (sector name breaks ties)."""
    out = (deduped.where(market_filter(sector, position_level))
           .groupBy("sector").agg(F.count(F.lit(1)).alias("postings"))
           .orderBy(F.desc("postings"), F.asc_nulls_last("sector")))
    return out.limit(limit) if limit else out


def _month_windows(months: DataFrame, size: int, ym: str = "ym") -> DataFrame:
    """Rank a distinct-month table both ways; tiny (one row per month)."""
    asc = Window.orderBy(F.col(ym))
    desc = Window.orderBy(F.col(ym).desc())
    return (months.withColumn("rank_asc", F.row_number().over(asc))
            .withColumn("rank_desc", F.row_number().over(desc))
            .withColumn("n_months", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))))


def industry_momentum(deduped: DataFrame, sector=None, position_level=None, size: int = 3,
                      decimals: int | None = 1) -> DataFrame:
    """M-03: average monthly postings per sector in the latest ``size`` months
    versus the ``size`` months before, over months present for the sector.

    The month ranking runs over the distinct months only (a calendar-bounded
    table); it is joined back to the (sector, month) counts by broadcast."""
    monthly = (deduped.where(market_filter(sector, position_level))
               .groupBy("sector", month_key("posting_date").alias("ym"))
               .agg(F.count(F.lit(1)).alias("postings")))
    months = _month_windows(monthly.select("ym").distinct(), size)
    months = months.withColumn(
        "window", F.when(F.col("rank_desc") <= size, "recent")
        .when(F.col("rank_desc") <= 2 * size, "prior")).where(F.col("window").isNotNull())
    m = monthly.join(F.broadcast(months.select("ym", "window")), "ym")
    rec = F.col("window") == "recent"
    pri = F.col("window") == "prior"
    out = m.groupBy("sector").agg(
        F.avg(F.when(rec, F.col("postings"))).alias("recent_avg_monthly"),
        F.avg(F.when(pri, F.col("postings"))).alias("prior_avg_monthly"),
        F.count_distinct(F.when(rec, F.col("ym"))).alias("recent_month_count"),
        F.count_distinct(F.when(pri, F.col("ym"))).alias("prior_month_count"))
    pct = F.when(F.col("prior_avg_monthly").isNotNull() & (F.col("prior_avg_monthly") != 0),
                 100 * (F.col("recent_avg_monthly") - F.col("prior_avg_monthly")) / F.col("prior_avg_monthly"))
    if decimals is not None:
        pct = F.bround(pct, decimals)
    return out.withColumn("pct_change", pct).orderBy(F.desc_nulls_last("pct_change"), F.asc_nulls_last("sector"))


def salary_trend(deduped: DataFrame, sector=None, position_level=None) -> DataFrame:
    """M-04: monthly rounded median ok-pay."""
    return (deduped.where(market_filter(sector, position_level))
            .groupBy(month_key("posting_date").alias("month"))
            .agg(F.round(F.median(ok_pay())).alias("median_pay")).orderBy("month"))


def level_ranking(deduped: DataFrame, sector=None, position_level=None) -> DataFrame:
    """M-05: postings per position level."""
    return (deduped.where(market_filter(sector, position_level))
            .groupBy("position_level").agg(F.count(F.lit(1)).alias("postings"))
            .orderBy(F.desc("postings"), F.asc_nulls_last("position_level")))


def employment_mix(deduped: DataFrame, sector=None, position_level=None) -> DataFrame:
    """M-06: postings and rounded median ok-pay per job type (null type dropped)."""
    return (deduped.where(market_filter(sector, position_level) & F.col("job_type").isNotNull())
            .groupBy("job_type")
            .agg(F.count(F.lit(1)).alias("postings"), F.round(F.median(ok_pay())).alias("median_pay"))
            .orderBy(F.desc("postings"), "job_type"))


def seasonality(deduped: DataFrame, sector=None, position_level=None) -> DataFrame:
    """M-07: (year, month) counts, then per calendar month: mean over the
    years present, years included, total."""
    ym = (deduped.where(market_filter(sector, position_level))
          .groupBy(F.year("posting_date").alias("yr"), F.month("posting_date").alias("month_num"))
          .agg(F.count(F.lit(1)).alias("postings")))
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return (ym.groupBy("month_num")
            .agg(F.round(F.avg("postings")).alias("avg_postings"),
                 F.count_distinct("yr").alias("years_included"),
                 F.sum("postings").alias("total_postings"))
            .withColumn("month_name", F.element_at(names, F.col("month_num"))).orderBy("month_num"))


def early_late_months(deduped: DataFrame, sector=None, position_level=None, size: int = 3,
                      start: str = WAGE_DECOMPOSITION_START_DATE) -> DataFrame:
    """M-08: the first and last ``size`` distinct months after the ramp; empty
    when fewer than ``2 * size`` months exist (the windows never overlap)."""
    months = (deduped.where(ramp_filter(sector, position_level, start))
              .select(month_key("posting_date").alias("ym")).distinct())
    ranked = _month_windows(months, size)
    return (ranked.where(F.col("n_months") >= 2 * size)
            .withColumn("window", F.when(F.col("rank_asc") <= size, "early")
                        .when(F.col("rank_desc") <= size, "late"))
            .where(F.col("window").isNotNull())
            .select("window", "ym"))


def wage_decomposition(deduped: DataFrame, sector=None, position_level=None, size: int = 3,
                       min_segment: int = MIN_SEGMENT_SIZE,
                       start: str = WAGE_DECOMPOSITION_START_DATE) -> DataFrame:
    """M-09: split the ok-pay change between the early and late windows into
    a within-segment (wage) effect and a mix effect; segment = sector x level.

    late_pay_at_early_mix prices the early mix at late pay; within = bridge -
    early, mix = late - bridge, so within + mix = late - early exactly.
    Returns no row when the windows do not exist."""
    windows = early_late_months(deduped, sector, position_level, size, start)
    filtered = (deduped.where(ramp_filter(sector, position_level, start) & (F.col("salary_flag") == "ok"))
                .select("sector", "position_level", month_key("posting_date").alias("ym"),
                        ((F.col("salary_min") + F.col("salary_max")) / 2.0).alias("pay")))
    tagged = filtered.join(F.broadcast(windows), "ym", "left")
    e, l_ = F.col("window") == "early", F.col("window") == "late"
    seg = tagged.groupBy("sector", "position_level").agg(
        F.avg(F.when(e, F.col("pay"))).alias("pay_early"),
        F.avg(F.when(l_, F.col("pay"))).alias("pay_late"),
        F.count(F.when(e, 1)).alias("n_early"),
        F.count(F.when(l_, 1)).alias("n_late"))
    valid = (F.col("n_early") >= min_segment) & (F.col("n_late") >= min_segment)

    def v(c: Column) -> Column:
        return F.when(valid, c)

    agg = seg.agg(
        F.count(v(F.lit(1))).cast("int").alias("n_segments"),
        F.sum(v(F.col("n_early"))).cast("int").alias("n_early_total"),
        F.sum(v(F.col("n_late"))).cast("int").alias("n_late_total"),
        F.sum("n_early").alias("total_early_all"),
        F.sum("n_late").alias("total_late_all"),
        F.try_divide(F.sum(v(F.col("pay_early") * F.col("n_early"))), F.sum(v(F.col("n_early")))).alias("actual_early"),
        F.try_divide(F.sum(v(F.col("pay_late") * F.col("n_late"))), F.sum(v(F.col("n_late")))).alias("actual_late"),
        F.try_divide(F.sum(v(F.col("pay_late") * F.col("n_early"))), F.sum(v(F.col("n_early")))).alias("late_pay_at_early_mix"))
    labels = windows.groupBy().agg(
        F.concat(F.min(F.when(F.col("window") == "early", F.col("ym"))), F.lit(" to "),
                 F.max(F.when(F.col("window") == "early", F.col("ym")))).alias("early_window_label"),
        F.concat(F.min(F.when(F.col("window") == "late", F.col("ym"))), F.lit(" to "),
                 F.max(F.when(F.col("window") == "late", F.col("ym")))).alias("late_window_label"),
        F.count(F.lit(1)).alias("_n_window_months"))
    return (agg.where(scalar(labels, "_n_window_months") > 0)
            .withColumn("early_window_label", scalar(labels, "early_window_label"))
            .withColumn("late_window_label", scalar(labels, "late_window_label"))
            .withColumn("total_change", F.col("actual_late") - F.col("actual_early"))
            .withColumn("within_effect", F.col("late_pay_at_early_mix") - F.col("actual_early"))
            .withColumn("mix_effect", F.col("actual_late") - F.col("late_pay_at_early_mix")))


def sector_mix_shift(deduped: DataFrame, position_level=None, limit: int = 8, size: int = 3,
                     start: str = WAGE_DECOMPOSITION_START_DATE) -> DataFrame:
    """M-10: each sector's share of all postings in the early vs late window;
    the ``limit`` largest absolute changes (sector breaks ties)."""
    windows = early_late_months(deduped, None, position_level, size, start)
    f = (deduped.where(ramp_filter(None, position_level, start))
         .select("sector", month_key("posting_date").alias("ym"))
         .join(F.broadcast(windows), "ym", "left"))
    e, l_ = F.col("window") == "early", F.col("window") == "late"
    per = f.groupBy("sector").agg(F.count(F.when(e, 1)).alias("n_early"), F.count(F.when(l_, 1)).alias("n_late"))
    tot = f.agg(F.count(F.when(e, 1)).alias("total_early"), F.count(F.when(l_, 1)).alias("total_late"),
                F.count(F.col("window")).alias("_nw"))
    out = (per.where(scalar(tot, "_nw") > 0)
           .select("sector",
                   F.try_divide(F.col("n_early") * 100.0, scalar(tot, "total_early")).alias("share_early_pct"),
                   F.try_divide(F.col("n_late") * 100.0, scalar(tot, "total_late")).alias("share_late_pct"))
           .withColumn("share_change_pct", F.col("share_late_pct") - F.col("share_early_pct")))
    return out.orderBy(F.abs("share_change_pct").desc_nulls_last(), F.asc_nulls_last("sector")).limit(limit)


def top_companies(deduped: DataFrame, sector=None, position_level=None, limit: int = 10) -> DataFrame:
    """M-11: top companies by postings with their share of all filtered postings
    and an agency-name flag (company breaks ties)."""
    f = deduped.where(market_filter(sector, position_level))
    total = scalar(f.agg(F.count(F.lit(1)).alias("_total")), "_total")
    ranked = (f.groupBy("company").agg(F.count(F.lit(1)).alias("postings"))
              .orderBy(F.desc("postings"), F.asc_nulls_last("company")).limit(limit))
    return (ranked
            .select("company", "postings",
                    (F.col("postings") * 100.0 / total).alias("share_pct"),
                    F.coalesce(F.col("company").rlike("(?i)" + AGENCY_NAME_PATTERN), F.lit(False)).alias("likely_agency")))


def agency_share(deduped: DataFrame, sector=None, position_level=None, limit: int = 10) -> DataFrame:
    """M-11 summary: top-``limit`` total share and the part held by likely agencies."""
    t = top_companies(deduped, sector, position_level, limit)
    return t.agg(F.sum("share_pct").alias("top_share_pct"),
                 F.coalesce(F.sum(F.when(F.col("likely_agency"), F.col("share_pct"))), F.lit(0.0)).alias("agency_share_pct"))


def leverage_vs_pay(deduped: DataFrame, position_level=None, min_n: int = MIN_LEVERAGE_SAMPLE,
                    cutoff: str = ENGAGEMENT_COUNTER_FREEZE_DATE) -> DataFrame:
    """M-12: applicants per opening and apply rate (postings before the
    counter cutoff) against median pay (full period), each side with its own
    sample floor; inner join of the two sector aggregates."""
    lvl = level_filter(position_level)
    lev = (deduped.where((F.col("posting_date") < F.to_date(F.lit(cutoff))) & F.col("sector").isNotNull() & lvl)
           .groupBy("sector")
           .agg(F.try_divide(F.sum("applications") * 1.0, F.sum("vacancies")).alias("applicants_per_opening"),
                F.try_divide(F.sum("applications") * 100.0, F.sum("views")).alias("apply_rate_pct"),
                F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") >= min_n).drop("_n"))
    pay = (deduped.where((F.col("salary_flag") == "ok") & F.col("sector").isNotNull() & lvl)
           .groupBy("sector").agg(F.median("salary_midpoint").alias("median_pay"), F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") >= min_n).drop("_n"))
    return lev.join(pay, "sector")


def contract_premium(finance: DataFrame, position_level=None, min_cohort: int = MIN_CONTRACT_COHORT_SAMPLE) -> DataFrame:
    """M-13: median loaded monthly cost per sector, Contract vs Permanent
    (pivot with explicit values), premium % where both cohorts reach the floor.
    Reads the finance fact (not deduplicated)."""
    f = finance.where(F.col("employment_cohort").isin("Contract", "Permanent")
                      & F.col("sector").isNotNull() & level_filter(position_level))
    piv = (f.groupBy("sector").pivot("employment_cohort", ["Contract", "Permanent"])
           .agg(F.median("loaded_monthly_cost_per_head").alias("cost"), F.count(F.lit(1)).alias("n")))
    return (piv.where((F.col("Contract_n") >= min_cohort) & (F.col("Permanent_n") >= min_cohort))
            .select("sector", F.try_divide((F.col("Contract_cost") - F.col("Permanent_cost")) * 100.0,
                                           F.col("Permanent_cost")).alias("contract_premium_pct")))


def repost_rate_by_sector(deduped: DataFrame, position_level=None, min_n: int = MIN_REPOST_SAMPLE,
                          cutoff: str = ENGAGEMENT_COUNTER_FREEZE_DATE) -> DataFrame:
    """M-14: repost share (%) per sector in the counters-complete 30-day cohort."""
    c = deduped.where((F.col("expiry_date") <= F.to_date(F.lit(cutoff))) & (F.col("listing_days") == 30)
                      & F.col("sector").isNotNull() & level_filter(position_level))
    return (c.groupBy("sector")
            .agg((F.avg(F.col("is_repost").cast("int")) * 100).alias("repost_rate_pct"),
                 F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_n))


def exposure_by_sector(finance: DataFrame, position_level=None) -> DataFrame:
    """M-15: median vacancy exposure per opening per sector (finance fact)."""
    rows = finance.where(F.col("sector").isNotNull() & level_filter(position_level))
    return with_exact_median(rows.select("sector").distinct(), rows, ["sector"],
                             "vacancy_exposure_per_opening", "median_exposure_per_opening")


def cross_view_corr(leverage: DataFrame, premium: DataFrame, reposts: DataFrame, exposure: DataFrame,
                    min_sectors: int = MIN_SECTORS_FOR_CORRELATION) -> DataFrame:
    """M-16: Pearson correlations across sectors between the market views,
    each emitted only when at least ``min_sectors`` sectors pair up.
    Inputs are per-sector aggregates (one row per sector)."""
    lp = premium.join(leverage.select("sector", "applicants_per_opening"), "sector")
    re_ = reposts.join(exposure, "sector")
    a = leverage.agg(F.count(F.lit(1)).alias("n"),
                     null_safe_corr("applicants_per_opening", "median_pay").alias("r"))
    a2 = lp.agg(F.count(F.lit(1)).alias("n"),
                null_safe_corr("applicants_per_opening", "contract_premium_pct").alias("r"))
    b = re_.agg(F.count(F.lit(1)).alias("n"),
                null_safe_corr("repost_rate_pct", "median_exposure_per_opening").alias("r"))
    rows = [
        a.select(F.lit("applicants_per_opening~median_pay").alias("pair"), "n", "r"),
        a2.select(F.lit("applicants_per_opening~contract_premium_pct").alias("pair"), "n", "r"),
        b.select(F.lit("repost_rate_pct~median_exposure_per_opening").alias("pair"), "n", "r"),
    ]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.where(F.col("n") >= min_sectors).withColumnRenamed("n", "n_sectors").withColumnRenamed("r", "pearson_r")


def extremes(df: DataFrame, x: str, n: int = 2, key: str = "sector") -> DataFrame:
    """O-05 / U-03: the ``n`` rows with the largest and the ``n`` with the
    smallest ``x`` (key breaks ties), concatenated and de-duplicated on ``key``."""
    hi = df.where(F.col(x).isNotNull()).orderBy(F.desc(x), F.asc_nulls_last(key)).limit(n)
    lo = df.where(F.col(x).isNotNull()).orderBy(F.asc(x), F.asc_nulls_last(key)).limit(n)
    return hi.unionByName(lo).dropDuplicates([key])


def hiring_trend(jobs: DataFrame, sector=None, granularity: str = "year", year: int | None = None) -> DataFrame:
    """M-17: yearly or monthly posting counts on the (not deduplicated) fact."""
    conds = [F.col("posting_date").isNotNull()]
    if sector:
        conds.append(F.col("sector") == F.lit(sector))
    if granularity == "month" and year is not None:
        conds.append((F.col("posting_date") >= F.lit(f"{int(year):04d}-01-01").cast("date"))
                     & (F.col("posting_date") < F.lit(f"{int(year) + 1:04d}-01-01").cast("date")))
    period = F.year("posting_date").cast("string") if granularity == "year" else month_key("posting_date")
    if granularity == "year":
        period = F.year("posting_date")
    return (jobs.where(all_of(conds)).groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("postings"))
            .orderBy("period"))
