"""Statistics from the analysis notebooks (N-01..N-13).

Everything reduces to grouped aggregates; the statistical tests run on the
per-stratum 2x2 cell counts (a handful of rows) as Column expressions.
Ranks (Spearman) come from per-column value histograms, and the live-posting
density from a sweep over each group's event days.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, month_key, null_safe_corr, right_closed_bins, scalar
from ..functions.ranks import SHARED, counts_below, look_up
from ..functions.stats import Z_975, chi2_sf, normal_two_sided_p
from ..session import stored
from .benchmark import EXP_ORDER, MIN_N, first_cycle, layer2_cohort

# ---- fixed values ------------------------------------------------------------
WARMUP_DAYS = 30
DENSITY_KEYS = ["sector", "position_level"]
MIN_EFFECT_N = 100
CENSOR_BINS = [-1, 7, 14, 21, 30, 45, 60, 400]
CENSOR_LABELS = ["(-1, 7]", "(7, 14]", "(14, 21]", "(21, 30]", "(30, 45]", "(45, 60]", "(60, 400]"]
RESPONSE_KEYS_3 = ["sector", "position_level", "pay_band"]
RESPONSE_KEYS_2 = ["sector", "position_level"]
SECURE = ["Permanent", "Full Time"]
HIGH_EXPERIENCE_YEARS = 3
SPEARMAN_COLUMNS = ["applications", "views", "repost_count", "is_repost", "vacancies", "listing_days",
                    "position_level_rank", "experience_level_rank", "job_type_permanent", "company_postings",
                    "posted_on_behalf"]
PROFILE_QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
# ------------------------------------------------------------------------------


def counter_regime(jobs: DataFrame) -> DataFrame:
    """N-01: monthly posting count and median views/applications, with the
    share of 'Open' postings already past expiry (one value, repeated)."""
    m = (jobs.where(F.col("posting_date").isNotNull()).groupBy(month_key("posting_date").alias("month"))
         .agg(F.count(F.lit(1)).alias("n"), F.median("views").alias("median_views"),
              F.median("applications").alias("median_apps")))
    last = scalar(jobs.agg(F.max("posting_date").alias("_last")), "_last")
    stale = (jobs.where(F.col("status_jobStatus") == "Open")
             .agg(F.avg(F.coalesce(F.col("expiry_date") < last, F.lit(False)).cast("double"))
                  .alias("stale_open_share")))
    return m.withColumn("stale_open_share", scalar(stale, "stale_open_share"))


def market_shape(market: DataFrame) -> DataFrame:
    """N-02: per position level postings, share %, median years and median
    midpoint, plus an 'All levels' row whose medians are recomputed over the
    whole market (GROUPING SETS ((level), ()))."""
    g = (market.groupingSets([["position_level"], []], "position_level")
         .agg(F.count(F.lit(1)).alias("postings"), F.median("seniority_years").alias("median_years"),
              F.median("salary_midpoint").alias("median_salary_midpoint"),
              F.grouping("position_level").alias("is_total"))
         .withColumn("position_level", F.when(F.col("is_total") == 1, F.lit("All levels"))
                     .otherwise(F.col("position_level")))
         .where(F.col("position_level").isNotNull()))
    # level shares are over postings with a level (normalised value counts);
    # the total row is the whole market at 100 %
    with_level = scalar(market.agg(F.count("position_level").alias("_n")), "_n")
    share = F.when(F.col("is_total") == 1, F.lit(100.0)).otherwise(F.col("postings") * 100.0 / with_level)
    return g.withColumn("share_pct", share).drop("is_total")


def competition_density(market: DataFrame, keys=DENSITY_KEYS, warmup: int = WARMUP_DAYS,
                        daily: bool = False) -> DataFrame:
    """N-03: live comparable postings per group and day (+1 on the posting date, -1 on the
    expiry date), median per group over the days of the valid window [first posting +
    warmup, last posting]. ``daily`` returns the per-day total across groups instead (the
    market's liquidity curve).

    An event sweep: the count changes on event days only and is weighted by the days it
    lasts, so a group has as many rows as it has event days, whatever the calendar's
    length; a wrong far date adds one row."""
    k = list(keys)
    keyed = market.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k]))
    bounds = market.agg(F.min("posting_date").alias("first"), F.max("expiry_date").alias("last_expiry"), F.max("posting_date").alias("last"))
    start = scalar(bounds, "first")
    opens, closes = F.date_add(start, warmup), F.least(scalar(bounds, "last"), scalar(bounds, "last_expiry"))

    def changes(day, delta):
        return keyed.where(F.col(day) >= start).groupBy(*k, F.col(day).alias("day")).agg((F.count(F.lit(1)) * delta).alias("delta"))
    # Every group starts with nothing on the first day, so its first stretch is counted too.
    known = keyed.where(F.col("posting_date").isNotNull() | F.col("expiry_date").isNotNull())
    begin = known.select(*k).distinct().select(*k, start.alias("day"), F.lit(0).cast("long").alias("delta"))
    events = begin.unionByName(changes("posting_date", 1)).unionByName(changes("expiry_date", -1))
    series = [] if daily else k
    swept = Window.partitionBy(*series).orderBy("day")
    live = (events.groupBy(*series, "day").agg(F.sum("delta").alias("delta"))
            .select(*series, F.greatest("day", opens).alias("since"),
                    F.least(F.date_sub(F.lead("day").over(swept), 1), closes).alias("until"),
                    F.sum("delta").over(swept.rowsBetween(Window.unboundedPreceding, 0)).alias("live"))
            .where(F.col("since") <= F.col("until")))
    if daily:
        return live.select(F.explode(F.sequence("since", "until")).alias("day"), F.col("live").alias("total_live"))
    days = (F.datediff("until", "since") + 1).cast("long")
    return live.groupBy(*k).agg(F.percentile("live", F.lit(0.5), days).alias("median_live_comparables"))


def live_postings_total(market: DataFrame, keys=DENSITY_KEYS) -> DataFrame:
    return competition_density(market, keys, daily=True)


def _effect(frame: DataFrame, key: str, min_n: int) -> DataFrame:
    return (frame.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.median("views").alias("median_views"),
                                   F.median("applications").alias("median_apps"))
            .where(F.col("n") >= min_n))


def exposure_effect(market: DataFrame, min_n: int = MIN_EFFECT_N) -> DataFrame:
    """N-05: medians by listing length over counters-complete postings."""
    return _effect(market.where(F.col("counters_complete")), "listing_days", min_n)


def cycle_effect(market: DataFrame, min_n: int = 0) -> DataFrame:
    """N-05: medians by repost count over the 30-day cohort (no floor: every
    cycle count is reported, unlike the listing-length table)."""
    return _effect(layer2_cohort(market), "repost_count", min_n)


def censoring_check(market: DataFrame, cutoff: str) -> DataFrame:
    """N-06: repost rate by days between expiry and the counter cutoff
    (right-closed bins)."""
    pool = layer2_cohort(market).withColumn("days_before_crawl", F.datediff(F.to_date(F.lit(cutoff)), F.col("expiry_date")))
    return (pool.withColumn("bucket", right_closed_bins("days_before_crawl", CENSOR_BINS, CENSOR_LABELS))
            .where(F.col("bucket").isNotNull())
            .groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_repost").cast("double")).alias("repost_rate")))


def response_benchmark(market: DataFrame, keys=RESPONSE_KEYS_3, min_n: int = MIN_N) -> DataFrame:
    """N-07: first-cycle response per cell: n, applications p10/p50/p90, zero
    rate, under-filled share, median views; cells under ``min_n`` dropped."""
    f = first_cycle(market)
    f = f.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]))
    g = f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("applications", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"),
        F.avg((F.col("applications") == 0).cast("double")).alias("zero_rate"),
        F.avg((F.col("applications") < F.col("vacancies")).cast("double")).alias("under_filled"),
        F.median("views").alias("views_p50"))
    return (g.select(*keys, "n", F.col("_q")[0].alias("apps_p10"), F.col("_q")[1].alias("apps_p50"),
                     F.col("_q")[2].alias("apps_p90"), "zero_rate", "under_filled", "views_p50")
            .where(F.col("n") >= min_n))


def response_lookup(market: DataFrame, requests: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """N-07 two-rung lookup: (sector, level, band) cell, else (sector, level),
    else the global first-cycle figures. ``requests``: request_id, sector,
    position_level, pay_band (band may be null)."""
    r3 = response_benchmark(market, RESPONSE_KEYS_3, min_n)
    r2 = response_benchmark(market, RESPONSE_KEYS_2, min_n)
    cols = ["n", "apps_p10", "apps_p50", "apps_p90", "zero_rate", "under_filled"]
    f = first_cycle(market)
    g = f.agg(F.count(F.lit(1)).alias("n"),
              F.percentile("applications", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"),
              F.avg((F.col("applications") == 0).cast("double")).alias("zero_rate"),
              F.avg((F.col("applications") < F.col("vacancies")).cast("double")).alias("under_filled"))
    g = g.select("n", F.col("_q")[0].alias("apps_p10"), F.col("_q")[1].alias("apps_p50"),
                 F.col("_q")[2].alias("apps_p90"), "zero_rate", "under_filled")
    a = requests.join(r3.select(*RESPONSE_KEYS_3, *[F.col(c).alias(f"r3_{c}") for c in cols]), RESPONSE_KEYS_3, "left")
    a = a.join(r2.select(*RESPONSE_KEYS_2, *[F.col(c).alias(f"r2_{c}") for c in cols]), RESPONSE_KEYS_2, "left")
    grain = (F.when(F.col("r3_n").isNotNull(), "sector + level + band")
             .when(F.col("r2_n").isNotNull(), "sector + level").otherwise("all postings (no comparable cell)"))
    out = a.withColumn("grain", grain)
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"r3_{c}"), F.col(f"r2_{c}"), scalar(g, c)))
    return out.select("request_id", *RESPONSE_KEYS_3, "grain", *cols)


def spearman_inputs(market: DataFrame) -> DataFrame:
    """N-08 input: the 11 encoded columns over counters-complete postings."""
    settled = market.where(F.col("counters_complete"))
    lvl = (settled.where(F.col("position_level").isNotNull()).groupBy("position_level")
           .agg(F.median("seniority_years").alias("_m"))
           .withColumn("position_level_rank", (F.row_number().over(Window.orderBy("_m", "position_level")) - 1).cast("double"))
           .drop("_m"))
    comp = settled.groupBy("company").agg(F.count(F.lit(1)).cast("double").alias("company_postings"))
    exp_rank = F.array_position(F.array(*[F.lit(x) for x in EXP_ORDER]), F.col("experience_level"))
    s = (settled.join(lvl, "position_level", "left").join(comp, "company", "left")
         .select(F.col("job_id"),
                 F.col("applications").cast("double").alias("applications"), F.col("views").cast("double").alias("views"),
                 F.col("repost_count").cast("double").alias("repost_count"),
                 F.col("is_repost").cast("double").alias("is_repost"),
                 F.col("vacancies").cast("double").alias("vacancies"),
                 F.col("listing_days").cast("double").alias("listing_days"),
                 "position_level_rank",
                 F.when(exp_rank > 0, (exp_rank - 1).cast("double")).alias("experience_level_rank"),
                 F.coalesce(F.col("job_type").isin(SECURE), F.lit(False)).cast("double").alias("job_type_permanent"),
                 F.when(F.col("company").isNotNull(), F.col("company_postings")).alias("company_postings"),
                 F.col("metadata_isPostedOnBehalf").cast("double").alias("posted_on_behalf")))
    return s


def spearman_matrix(market: DataFrame, columns=SPEARMAN_COLUMNS, nullable=("experience_level_rank",), shared: int = SHARED) -> DataFrame:
    """N-08: pairwise Spearman correlations with pairwise deletion and average
    ranks. A pair's ranks are computed over the rows where the pair's
    ``nullable`` columns are present (the other columns are never null after
    cleaning and enrichment), so each pair is ranked on exactly its complete
    rows. Values are counted per column in one pass, ranked by range with partition
    offsets and brought back to the rows from one broadcast table of bounded size
    (``functions.ranks``)."""
    s = stored(spearman_inputs(market), "spearman_inputs")
    cols, nullable = list(columns), list(nullable)
    pairs = [(x, y, tuple(sorted({x, y} & set(nullable)))) for i, x in enumerate(cols) for y in cols[i + 1:]]
    regimes = sorted({reg for _, _, reg in pairs})
    tags = {reg: ("_".join(reg) or "all") for reg in regimes}
    conds = {reg: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in reg], F.lit(True)) for reg in regimes}
    long = s.select(*[conds[r].alias(f"_in_{tags[r]}") for r in regimes],
                    F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("v"))
                                        for i, c in enumerate(cols)])).alias("x"))
    counts = (long.where(F.col("x.v").isNotNull()).groupBy(F.col("x.col").alias("col"), F.col("x.v").alias("v"))
              .agg(F.count("*").alias("n"), *[F.count_if(F.col(f"_in_{tags[r]}")).alias(tags[r]) for r in regimes]))
    below = counts_below(counts, "col", "v", [tags[r] for r in regimes])
    average = {r: F.when(F.col(tags[r]) > 0, F.col(f"below_{tags[r]}") + (F.col(tags[r]) + 1) / 2.0) for r in regimes}
    ranks = stored(below.select("col", "v", "n", *tags.values(), *[average[r].alias(f"r_{tags[r]}") for r in regimes]), "ranks")
    held = {r["col"]: r for r in ranks.groupBy("col").agg(
        F.count("*").alias("distinct"), F.sum("n").alias("rows"), *[F.sum(t).alias(t) for t in tags.values()]).collect()}
    rows = {t: max((r[t] for r in held.values()), default=0) for t in tags.values()}
    ranked = look_up(s, cols, ranks, [f"r_{t}" for t in tags.values()], "n",
                     {i: (r["distinct"], r["rows"]) for i, r in held.items()}, shared)
    # A rank's distance from the mean rank, which is known for a column without nulls.
    away = ranked.select(*[F.when(conds[reg], F.col(f"r_{t}_{c}") - (rows[t] + 1) / 2.0).alias(f"{t}|{c}")
                           for reg, t in tags.items() for c in cols])
    full = {(c, t) for i, c in enumerate(cols) for t in tags.values() if i in held and held[i][t] == rows[t]}
    sums, rhos = {}, []
    for x, y, reg in pairs:
        t, name = tags[reg], f"{x}|{y}"
        if {(x, t), (y, t)} <= full:
            sums[name] = F.expr(f"sum(`{t}|{x}` * `{t}|{y}`)")
            for z in (x, y):
                sums[f"sq|{t}|{z}"] = F.expr(f"sum(`{t}|{z}` * `{t}|{z}`)")
            rhos.append(f"try_divide(`{name}`, sqrt(`sq|{t}|{x}` * `sq|{t}|{y}`)) AS `{name}`")
        else:
            sums[name] = null_safe_corr(F.col(f"{t}|{x}"), F.col(f"{t}|{y}"))
            rhos.append(f"`{name}`")
    wide = away.agg(*[c.alias(n) for n, c in sums.items()]).selectExpr(*rhos)
    stack = ", ".join(f"'{x}', '{y}', `{x}|{y}`" for x, y, _r in pairs)
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) AS (column_a, column_b, spearman_rho)")


def _strata(market: DataFrame) -> DataFrame:
    """2x2 cells per pay band: a = exposed case (>=3 yr, reposted), b = exposed
    non-case, c = unexposed case, d = unexposed non-case."""
    pool = layer2_cohort(market).where(F.col("pay_band").isNotNull())
    hi = clip("seniority_years", 0, 15) >= HIGH_EXPERIENCE_YEARS
    rep = F.col("is_repost")
    return pool.groupBy("pay_band").agg(
        F.count(F.when(hi & rep, 1)).cast("double").alias("a"),
        F.count(F.when(hi & ~rep, 1)).cast("double").alias("b"),
        F.count(F.when(~hi & rep, 1)).cast("double").alias("c"),
        F.count(F.when(~hi & ~rep, 1)).cast("double").alias("d"))


def mantel_haenszel(market: DataFrame) -> DataFrame:
    """N-09: crude odds ratio, Mantel-Haenszel pooled odds ratio over pay
    bands, and the (uncorrected) test of a null pooled effect."""
    s = _strata(market).withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    s = s.withColumns({
        "e": (F.col("a") + F.col("b")) * (F.col("a") + F.col("c")) / F.col("n"),
        # A stratum of one row says nothing: its variance is null and adds nothing.
        "v": F.try_divide((F.col("a") + F.col("b")) * (F.col("c") + F.col("d")) * (F.col("a") + F.col("c")) * (F.col("b") + F.col("d")),
                          F.col("n") * F.col("n") * (F.col("n") - 1)),
    })
    agg = s.agg(F.sum("a").alias("A"), F.sum("b").alias("B"), F.sum("c").alias("Cc"), F.sum("d").alias("D"),
                F.sum(F.col("a") * F.col("d") / F.col("n")).alias("r"), F.sum(F.col("b") * F.col("c") / F.col("n")).alias("s"),
                F.sum("e").alias("E"), F.sum("v").alias("V"), F.count(F.lit(1)).alias("strata"),
                F.sum("n").alias("n"))
    chi2 = F.try_divide((F.col("A") - F.col("E")) * (F.col("A") - F.col("E")), F.col("V"))
    return agg.select(F.col("n").cast("long").alias("n"), F.col("strata"),
                      F.try_divide(F.col("A") * F.col("D"), F.col("B") * F.col("Cc")).alias("crude_odds_ratio"),
                      F.try_divide(F.col("r"), F.col("s")).alias("mh_odds_ratio"),
                      chi2.alias("null_test_chi2"),
                      chi2_sf(chi2, F.lit(1)).alias("null_test_p"))


def stratum_odds_ratio(market: DataFrame) -> DataFrame:
    """N-10: per pay band the repost rates below / at-or-above 3 years, their
    difference (points), the odds ratio, its 95 % Wald interval and p-value. An empty
    cell counts as one half in the ratio and its interval."""
    s = _strata(market)
    a, b, c, d = (F.col(x) for x in "abcd")
    oa, ob, oc, od = (F.when(x == 0, 0.5).otherwise(x) for x in (a, b, c, d))
    lor = F.log(oa * od / (ob * oc))
    se = F.sqrt(1 / oa + 1 / ob + 1 / oc + 1 / od)
    lo_rate = F.try_divide(c, c + d) * 100
    hi_rate = F.try_divide(a, a + b) * 100
    return s.select("pay_band", (a + b + c + d).cast("long").alias("n"),
                    lo_rate.alias("repost_pct_lt3"), hi_rate.alias("repost_pct_gte3"),
                    (hi_rate - lo_rate).alias("diff_pp"),
                    (oa * od / (ob * oc)).alias("odds_ratio"),
                    F.exp(lor - Z_975 * se).alias("ci_low"), F.exp(lor + Z_975 * se).alias("ci_high"),
                    normal_two_sided_p(lor / se).alias("p_value"))


def breslow_day(market: DataFrame) -> DataFrame:
    """N-10: Breslow-Day test that the per-band odds ratios are equal, around
    the Mantel-Haenszel pooled odds ratio (no Tarone adjustment); df = strata - 1."""
    s = _strata(market).withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    psi = s.agg(F.try_divide(F.sum(F.col("a") * F.col("d") / F.col("n")), F.sum(F.col("b") * F.col("c") / F.col("n"))).alias("psi"),
                F.count(F.lit(1)).alias("k"))
    t = s.withColumns({"psi": scalar(psi, "psi"), "k": scalar(psi, "k")})
    r, m, n, p = F.col("a") + F.col("b"), F.col("a") + F.col("c"), F.col("n"), F.col("psi")
    qa = 1 - p
    qb = n - r - m + p * (r + m)
    qc = -p * r * m
    disc = F.sqrt(qb * qb - 4 * qa * qc)
    lo, hi = F.greatest(F.lit(0.0), r + m - n), F.least(r, m)
    root1 = F.try_divide(-qb + disc, 2 * qa)
    root2 = F.try_divide(-qb - disc, 2 * qa)
    A = (F.when(F.abs(qa) < 1e-12, r * m / n)
         .when((root1 >= lo - 1e-9) & (root1 <= hi + 1e-9), root1).otherwise(root2))
    # A stratum with an empty margin has no variance and adds nothing.
    one = F.lit(1.0)
    inverse = F.try_divide(one, A) + F.try_divide(one, r - A) + F.try_divide(one, m - A) + F.try_divide(one, n - r - m + A)
    t = t.withColumn("_term", F.coalesce((F.col("a") - A) * (F.col("a") - A) * inverse, F.lit(0.0)))
    out = t.groupBy("k").agg(F.sum("_term").alias("chi2"))
    return out.select((F.col("k") - 1).alias("df"), "chi2", chi2_sf(F.col("chi2"), F.col("k") - 1).alias("p_value"))


def pay_band_spread(market: DataFrame) -> DataFrame:
    """N-11: medians of min / midpoint / max per pay band over the 30-day
    cohort (half-even rounding) and, as a row with a null band, the postings
    that carry no band."""
    cohort = layer2_cohort(market)
    g = cohort.groupBy("pay_band").agg(F.count(F.lit(1)).alias("n"),
                                       F.bround(F.median("salary_min"), 0).alias("min_p50"),
                                       F.bround(F.median("salary_midpoint"), 0).alias("mid_p50"),
                                       F.bround(F.median("salary_max"), 0).alias("max_p50"))
    return g


def applications_profile(market: DataFrame) -> DataFrame:
    """N-12: first-cycle applications: count, mean, std, min, percentiles,
    max, zero rate and under-filled share."""
    f = first_cycle(market)
    x = F.col("applications")
    q = F.percentile(x, F.array(*[F.lit(v) for v in PROFILE_QUANTILES]))
    out = f.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"), q.alias("_q"), F.max(x).alias("max"),
                F.avg((x == 0).cast("double")).alias("zero_rate"),
                F.avg((x < F.col("vacancies")).cast("double")).alias("under_filled_rate"))
    names = ["p10", "p25", "p50", "p75", "p90", "p99"]
    return out.select("count", "mean", "std", "min", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)],
                      "max", "zero_rate", "under_filled_rate")


def repost_overall(market: DataFrame) -> DataFrame:
    """N-13: repost rate by year bucket, not split by pay (the confounded view)."""
    pool = layer2_cohort(market).where(F.col("yrs_bucket").isNotNull())
    return pool.groupBy("yrs_bucket").agg(F.count(F.lit(1)).alias("n"),
                                          F.avg(F.col("is_repost").cast("double")).alias("repost_rate"))
