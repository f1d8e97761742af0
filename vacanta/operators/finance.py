"""Finance operators (P-01..P-15): loaded workforce cost, vacancy budget
exposure, contract-vs-permanent conversion economics, scenario re-pricing.

Scenario parameters enter plans as literals (constant-folded by Catalyst);
pricing many scenarios at once expands each row over a literal array of the
scenarios the caller passes in (a Generate, no join).
"""
from __future__ import annotations

from functools import reduce

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quantile import with_exact_median
from ..functions.expr import all_of, clip, first_match, scalar

# ---- fixed values ------------------------------------------------------------
FINANCE_COLUMNS = [
    "job_id", "title", "company", "sector", "sub_sector", "position_level", "employment_type",
    "salary_minimum", "salary_maximum", "salary_midpoint_monthly", "salary_type", "posting_date",
    "expiry_date", "number_of_vacancies", "repost_count", "posting_window_days",
    "new_posting_lag_days", "employment_cohort", "salary_low_outlier_flag",
    "salary_high_outlier_flag", "planning_salary_midpoint_monthly", "employer_burden_rate",
    "agency_premium_rate", "total_cost_multiplier", "loaded_monthly_cost_per_head",
    "loaded_monthly_cost_for_vacancies", "daily_loaded_cost_for_vacancies",
    "vacancy_budget_exposure", "vacancy_exposure_per_opening", "pwm_sector_candidate",
    "pwm_monthly_floor", "pwm_salary_check_status", "salary_frequency_interpretation",
    "salary_frequency_review_required",
]
PERMANENT_PATTERN = "permanent|full time|full-time"
CONTRACT_PATTERN = "contract|temporary|freelance|flexi"
# Progressive-wage candidate rules: (label, case-insensitive title regex, sectors); first hit wins.
PWM_RULES = [
    ("Cleaning", r"\b(?:cleaner|cleaning|housekeep(?:er|ing))\b", ["Environment / Health", "General Work", "Hospitality"]),
    ("Security", r"\b(?:security officer|security guard|security supervisor|guard)\b", ["Security and Investigation"]),
    ("Landscape", r"\b(?:landscap(?:e|ing)|gardener|horticultur)\b", ["Environment / Health", "General Work"]),
    ("Lift and escalator", r"\b(?:lift|escalator)\b", ["Repair and Maintenance", "Engineering"]),
    ("Retail", r"\b(?:retail|cashier|shop assistant)\b", ["Sales / Retail"]),
    ("Food services", r"\b(?:barista|waiter|waitress|kitchen|service crew|cook)\b", ["F&B"]),
    ("Waste management", r"\b(?:waste|refuse|recycl)\b", ["Environment / Health", "General Work"]),
]
# Exact employment-type map of the prototype (P-01 variant).
COHORT_MAP = {"Permanent": "Permanent", "Full Time": "Permanent", "Contract": "Contract",
              "Temporary": "Contract", "Freelance": "Contract", "Flexi-work": "Contract"}
# Recruitment-type classification of the finance view (P-12), in order.
RECRUITMENT_RULES = [
    ("Permanent", "permanent|full[ -]?time"),
    ("Contract", "contract"),
    ("Temp", "temp|temporary|part[ -]?time|intern|attachment|freelance|flexi"),
]
RECRUITMENT_ORDER = ["Permanent", "Contract", "Temp"]
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    """Workforce-cost assumptions (defaults = the published scenario file)."""
    permanent_employer_burden_rate: float = 0.22
    contract_employer_burden_rate: float = 0.02
    contract_agency_premium_rate: float = 0.12
    days_per_month: float = 30.3
    cost_neutral_tolerance_rate: float = 0.03
    salary_planning_cap_quantile: float = 0.995
    min_cohort_postings: int = 30

    def as_row(self) -> dict:
        return asdict(self)


DEFAULT = Scenario()


def employment_cohort(job_type) -> Column:
    """P-01: Permanent / Contract / Other from the lower-cased type text."""
    t = F.lower(F.coalesce(F.col(job_type) if isinstance(job_type, str) else job_type, F.lit("")))
    return first_match([(t.rlike(PERMANENT_PATTERN), "Permanent"), (t.rlike(CONTRACT_PATTERN), "Contract")], "Other")


def employment_cohort_exact(job_type) -> Column:
    """P-01 prototype variant: exact type-name map, else Other."""
    t = F.col(job_type) if isinstance(job_type, str) else job_type
    return first_match([(t == k, v) for k, v in COHORT_MAP.items()], "Other")


def recruitment_type(employment_type) -> Column:
    """P-12 classification (differs from P-01: Temporary is Temp here)."""
    t = F.lower(F.coalesce(F.col(employment_type), F.lit("")))
    return first_match([(t.rlike(p), lbl) for lbl, p in RECRUITMENT_RULES], "Other")


def pwm_candidate(title: str = "title", sector: str = "sector") -> Column:
    """P-02: first progressive-wage rule whose title regex and sector list match."""
    rules = [(F.col(title).rlike("(?i)" + pat) & F.col(sector).isin(inds), lbl) for lbl, pat, inds in PWM_RULES]
    return first_match(rules, F.lit(None).cast("string"))


def _cost_columns(df: DataFrame, s: Scenario) -> DataFrame:
    """P-04/P-07: cost and exposure columns from the planning salary."""
    coh = F.col("employment_cohort")
    return (df.withColumns({
        "employer_burden_rate": first_match([(coh == "Permanent", F.lit(s.permanent_employer_burden_rate)),
                                             (coh == "Contract", F.lit(s.contract_employer_burden_rate))], F.lit(0.0)),
        "agency_premium_rate": F.when(coh == "Contract", F.lit(s.contract_agency_premium_rate)).otherwise(F.lit(0.0)),
    }).withColumn("total_cost_multiplier", 1 + F.col("employer_burden_rate") + F.col("agency_premium_rate"))
      .withColumn("loaded_monthly_cost_per_head", F.col("planning_salary_midpoint_monthly") * F.col("total_cost_multiplier"))
      .withColumn("loaded_monthly_cost_for_vacancies", F.col("loaded_monthly_cost_per_head") * F.col("number_of_vacancies"))
      .withColumn("daily_loaded_cost_for_vacancies", F.col("loaded_monthly_cost_for_vacancies") / F.lit(s.days_per_month))
      .withColumn("vacancy_budget_exposure", F.col("daily_loaded_cost_for_vacancies") * F.col("posting_window_days"))
      .withColumn("vacancy_exposure_per_opening",
                  F.try_divide(F.col("vacancy_budget_exposure"), F.nullif(F.col("number_of_vacancies"), F.lit(0)))))


def planning_salary(df: DataFrame, mid: str = "salary_midpoint_monthly", q: float = DEFAULT.salary_planning_cap_quantile,
                    approx: bool = False) -> DataFrame:
    """P-03: two-sided winsorisation at the global (1-q, q) quantiles of the
    midpoint (exact, linear interpolation). The quantiles are one single-row
    aggregate read as scalar subqueries; null midpoints stay null and are not flagged."""
    pct = (lambda p: F.percentile_approx(F.col(mid), p, 10000)) if approx else (lambda p: F.percentile(F.col(mid), F.lit(p)))
    bounds = df.agg(pct(1 - q).cast("double").alias("_floor"), pct(q).cast("double").alias("_cap"))
    lo, hi = scalar(bounds, "_floor"), scalar(bounds, "_cap")
    x = F.col(mid)
    return df.withColumns({
        "salary_low_outlier_flag": F.coalesce(x < lo, F.lit(False)),
        "salary_high_outlier_flag": F.coalesce(x > hi, F.lit(False)),
        "planning_salary_midpoint_monthly": clip(x, lo, hi),
    })


def finance_features(jobs: DataFrame, s: Scenario = DEFAULT, keep_skills: bool = True) -> DataFrame:
    """P-04: the 34-column finance fact, one row per posting (not deduplicated).
    ``skills`` is carried beside it (for the keyword scope, F-05) when asked."""
    df = jobs.select(
        "job_id", "title", "company",
        F.coalesce(F.col("sector"), F.lit("Unclassified")).alias("sector"),
        F.coalesce(F.col("sub_sector"), F.lit("Unspecified")).alias("sub_sector"),
        "position_level", F.col("job_type").alias("employment_type"),
        F.col("salary_min").alias("salary_minimum"), F.col("salary_max").alias("salary_maximum"),
        ((F.col("salary_min") + F.col("salary_max")) / 2.0).alias("salary_midpoint_monthly"),
        F.lit("Monthly").alias("salary_type"), "posting_date", "expiry_date",
        F.coalesce(F.col("vacancies"), F.lit(0)).alias("number_of_vacancies"), "repost_count",
        clip(F.datediff("expiry_date", "posting_date"), 0).alias("posting_window_days"),
        F.lit(None).cast("int").alias("new_posting_lag_days"),
        employment_cohort("job_type").alias("employment_cohort"),
        *(["skills"] if keep_skills else []))
    df = planning_salary(df, q=s.salary_planning_cap_quantile)
    df = _cost_columns(df, s)
    df = df.withColumn("pwm_sector_candidate", pwm_candidate())
    df = df.withColumns({
        "pwm_monthly_floor": F.lit(None).cast("double"),
        "pwm_salary_check_status": F.when(F.col("pwm_sector_candidate").isNotNull(), "policy_floor_not_configured")
        .otherwise("not_a_pwm_sector_candidate"),
        "salary_frequency_interpretation": F.lit("monthly_as_declared"),
        "salary_frequency_review_required": F.lit(False),
    })
    return df.select(*FINANCE_COLUMNS, *(["skills"] if keep_skills else []))


def reprice(finance: DataFrame, s: Scenario) -> DataFrame:
    """P-07: recompute the cost columns from ``s`` (rates are literals)."""
    cost_cols = ["employer_burden_rate", "agency_premium_rate", "total_cost_multiplier",
                 "loaded_monthly_cost_per_head", "loaded_monthly_cost_for_vacancies",
                 "daily_loaded_cost_for_vacancies", "vacancy_budget_exposure", "vacancy_exposure_per_opening"]
    return _cost_columns(finance.drop(*cost_cols), s)


def reprice_many(finance: DataFrame, scenarios) -> DataFrame:
    """P-07, many scenarios in one job: every posting priced under every
    scenario the caller passes (the output is postings x scenarios by
    definition). ``scenarios`` is a sequence of ``(name, Scenario)``; their
    rates become a literal array that each row expands over (a Generate in
    the scan's stage: no join, no shuffle)."""
    rates = F.array(*[F.struct(F.lit(name).alias("scenario"),
                               F.lit(float(sc.permanent_employer_burden_rate)).alias("permanent_employer_burden_rate"),
                               F.lit(float(sc.contract_employer_burden_rate)).alias("contract_employer_burden_rate"),
                               F.lit(float(sc.contract_agency_premium_rate)).alias("contract_agency_premium_rate"),
                               F.lit(float(sc.days_per_month)).alias("days_per_month"))
                      for name, sc in scenarios])
    coh = F.col("employment_cohort")
    df = finance.select("*", F.inline(rates))
    burden = first_match([(coh == "Permanent", F.col("permanent_employer_burden_rate")),
                          (coh == "Contract", F.col("contract_employer_burden_rate"))], F.lit(0.0))
    prem = F.when(coh == "Contract", F.col("contract_agency_premium_rate")).otherwise(F.lit(0.0))
    per_head = F.col("planning_salary_midpoint_monthly") * (1 + burden + prem)
    daily = per_head * F.col("number_of_vacancies") / F.col("days_per_month")
    return df.select("scenario", "job_id", "sector", "employment_cohort",
                     per_head.alias("loaded_monthly_cost_per_head"),
                     (daily * F.col("posting_window_days")).alias("vacancy_budget_exposure"))


def year_range(col: str, year: int) -> Column:
    """``year(col) = year`` written as a half-open date range, which the
    Parquet reader can push down and use to skip row groups."""
    return (F.col(col) >= F.lit(f"{int(year):04d}-01-01").cast("date")) & \
           (F.col(col) < F.lit(f"{int(year) + 1:04d}-01-01").cast("date"))


def finance_scope(year: int, sector: str, sub_sector: str | None = None, keyword: str | None = None) -> Column:
    """F-05: posting year, sector, optional sub-sector, optional keyword found
    (literally, case-insensitively) in the title or in the posting's skills."""
    conds = [year_range("posting_date", year), F.col("sector") == F.lit(sector)]
    if sub_sector:
        conds.append(F.col("sub_sector") == F.lit(sub_sector))
    if keyword and keyword.strip():
        kw = keyword.strip().lower()
        conds.append(F.lower(F.coalesce(F.col("title"), F.lit(""))).contains(kw)
                     | F.lower(F.coalesce(F.col("skills"), F.lit(""))).contains(kw))
    return all_of(conds)


def industry_budget_risk(finance: DataFrame) -> DataFrame:
    """P-05: per sector postings, vacancies, window median/p90, total exposure,
    median exposure per opening, and rank by total exposure (a window over
    the per-sector aggregate, one row per sector)."""
    g = (finance.where(F.col("sector").isNotNull()).groupBy("sector").agg(
        F.count_distinct("job_id").alias("postings"),
        F.sum("number_of_vacancies").alias("vacancies"),
        F.median("posting_window_days").alias("median_posting_window_days"),
        F.percentile("posting_window_days", F.lit(0.9)).alias("p90_posting_window_days"),
        F.sum("vacancy_budget_exposure").alias("total_vacancy_budget_exposure")))
    w = Window.orderBy(F.desc_nulls_last("total_vacancy_budget_exposure"), F.asc("sector"))
    ranked = g.withColumn("budget_exposure_rank", F.row_number().over(w))
    return with_exact_median(ranked, finance.where(F.col("sector").isNotNull()), ["sector"],
                             "vacancy_exposure_per_opening", "median_exposure_per_opening").orderBy("budget_exposure_rank")


def _decision(rate: Column, tol: float) -> Column:
    return first_match([(rate <= -tol, "Savings"), (rate >= tol, "Cost premium")], "Cost neutral")


def conversion_economics(finance: DataFrame, s: Scenario = DEFAULT,
                         keys=("sector", "position_level"), min_postings: int | None = None,
                         drop_null_keys: bool = True) -> DataFrame:
    """P-06 / P-09: Contract vs Permanent per segment (pivot with explicit
    values), both cohorts at least ``min_postings``, cost delta, delta rate
    and a decision at +/- the tolerance."""
    n_min = s.min_cohort_postings if min_postings is None else min_postings
    f = finance.where(F.col("employment_cohort").isin("Permanent", "Contract"))
    if drop_null_keys:
        f = f.where(all_of([F.col(k).isNotNull() for k in keys]))
    piv = (f.groupBy(*keys).pivot("employment_cohort", ["Contract", "Permanent"])
           .agg(F.count_distinct("job_id").alias("postings"),
                F.median("loaded_monthly_cost_per_head").alias("median_loaded_monthly_cost"),
                F.median("posting_window_days").alias("median_posting_window_days")))
    ren = {}
    for coh in ("Contract", "Permanent"):
        for m in ("postings", "median_loaded_monthly_cost", "median_posting_window_days"):
            ren[f"{coh}_{m}"] = f"{m}_{coh.lower()}"
    out = piv.withColumnsRenamed(ren)
    out = out.where(F.col("median_loaded_monthly_cost_contract").isNotNull()
                    & F.col("median_loaded_monthly_cost_permanent").isNotNull()
                    & (F.col("postings_contract") >= n_min) & (F.col("postings_permanent") >= n_min))
    delta = F.col("median_loaded_monthly_cost_contract") - F.col("median_loaded_monthly_cost_permanent")
    rate = F.try_divide(delta, F.nullif(F.col("median_loaded_monthly_cost_permanent"), F.lit(0.0)))
    return (out.withColumn("monthly_cost_delta_contract_minus_permanent", delta)
            .withColumn("contract_cost_delta_rate", rate)
            .withColumn("conversion_decision", _decision(F.col("contract_cost_delta_rate"), s.cost_neutral_tolerance_rate))
            .orderBy(F.asc_nulls_last("monthly_cost_delta_contract_minus_permanent"), *[F.asc_nulls_last(k) for k in keys]))


def conversion_base(finance: DataFrame, s: Scenario = DEFAULT, scope: Column | None = None,
                    min_postings: int | None = None) -> DataFrame:
    """P-09: conversion economics by sector x sub-sector x level in a scope."""
    f = reprice(finance, s)
    if scope is not None:
        f = f.where(scope)
    return conversion_economics(f, s, keys=("sector", "sub_sector", "position_level"),
                                min_postings=min_postings, drop_null_keys=False)


def conversion_summary(conv: DataFrame) -> DataFrame:
    """P-10: segments, mean delta rate and median monthly delta per decision."""
    return conv.groupBy("conversion_decision").agg(
        F.count(F.lit(1)).alias("segments"),
        F.avg("contract_cost_delta_rate").alias("avg_delta_rate"),
        F.median("monthly_cost_delta_contract_minus_permanent").alias("median_monthly_delta")).orderBy(
        F.desc("segments"), "conversion_decision")


def conversion_candidates(conv: DataFrame, decision: str, limit: int = 15) -> DataFrame:
    """P-10: the ``limit`` segments of one decision with the largest absolute delta."""
    cols = ["sector", "sub_sector", "position_level", "postings_contract", "postings_permanent",
            "median_loaded_monthly_cost_contract", "median_loaded_monthly_cost_permanent",
            "monthly_cost_delta_contract_minus_permanent", "contract_cost_delta_rate", "conversion_decision"]
    return (conv.where(F.col("conversion_decision") == decision).select(*cols)
            .orderBy(F.abs("monthly_cost_delta_contract_minus_permanent").desc_nulls_last(),
                     "sector", "sub_sector", "position_level").limit(limit))


def finance_headline(finance: DataFrame, s: Scenario = DEFAULT, scope: Column | None = None) -> DataFrame:
    """P-08: postings, total exposure, medians, cohort counts and contract share."""
    f = reprice(finance, s)
    if scope is not None:
        f = f.where(scope)
    total = (f.agg(F.count(F.lit(1)).alias("postings"),
                  F.sum("vacancy_budget_exposure").alias("total_budget_exposure"),
                  F.sum(F.when(F.col("employment_cohort") == "Contract", 1).otherwise(0)).alias("contract_postings"),
                  F.sum(F.when(F.col("employment_cohort") == "Permanent", 1).otherwise(0)).alias("permanent_postings"))
            .withColumn("contract_share_pct", F.try_divide(F.col("contract_postings") * 100.0, F.col("postings"))))
    for value, name in (("vacancy_exposure_per_opening", "median_exposure_per_opening"),
                        ("loaded_monthly_cost_per_head", "median_loaded_monthly_cost_per_head")):
        total = with_exact_median(total, f, [], value, name)
    return total


def _exposure_aggs():
    return [F.count(F.lit(1)).alias("postings"),
            F.sum("number_of_vacancies").alias("vacancies"),
            F.median("posting_window_days").alias("median_posting_window_days"),
            F.sum("vacancy_budget_exposure").alias("total_vacancy_budget_exposure")]


def _top_exposures(f: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The ``limit`` groups with most exposure; medians are taken for those alone."""
    order = [F.desc_nulls_last("total_vacancy_budget_exposure"), *[F.asc_nulls_last(k) for k in keys]]
    top = f.groupBy(*keys).agg(*_exposure_aggs()).where(F.col("vacancies") > 0).orderBy(*order).limit(limit)
    wanted = top.select(*[F.col(k).alias(f"_t_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [f[k].eqNullSafe(wanted[f"_t_{k}"]) for k in keys])
    rows = f.join(wanted, same, "left_semi")
    return with_exact_median(top, rows, keys, "vacancy_exposure_per_opening", "median_exposure_per_opening").orderBy(*order)


def exposure_by_level(finance: DataFrame, s: Scenario = DEFAULT, scope: Column | None = None, limit: int = 12) -> DataFrame:
    """P-11: exposure per position level (vacancies > 0), top ``limit`` by total."""
    f = reprice(finance, s)
    if scope is not None:
        f = f.where(scope)
    return _top_exposures(f, ["position_level"], limit)


def exposure_watchlist(finance: DataFrame, s: Scenario = DEFAULT, scope: Column | None = None, limit: int = 15) -> DataFrame:
    """P-11: slow/expensive segments (sector x sub-sector x level x cohort), top ``limit``."""
    f = reprice(finance, s)
    if scope is not None:
        f = f.where(scope)
    return _top_exposures(f, ["sector", "sub_sector", "position_level", "employment_cohort"], limit)


def recruitment_overview(finance: DataFrame, s: Scenario = DEFAULT, scope: Column | None = None) -> DataFrame:
    """P-12: Permanent/Contract/Temp mix in scope, with each type's share of the
    three and their coverage of all postings in scope (fixed type order)."""
    f = reprice(finance, s)
    if scope is not None:
        f = f.where(scope)
    typed = f.withColumn("recruitment_type", recruitment_type("employment_type"))
    g = (typed.where(F.col("recruitment_type").isin(RECRUITMENT_ORDER)).groupBy("recruitment_type").agg(
        F.count(F.lit(1)).alias("postings"), F.sum("number_of_vacancies").alias("vacancies"),
        F.median("planning_salary_midpoint_monthly").alias("median_salary_midpoint"),
        F.median("posting_window_days").alias("median_posting_window_days"),
        F.sum("vacancy_budget_exposure").alias("total_budget_exposure")))
    total = scalar(f.agg(F.count(F.lit(1)).alias("_all")), "_all")
    w = Window.partitionBy(F.lit(1))      # over the <= 3 typed rows
    order = F.array_position(F.array(*[F.lit(x) for x in RECRUITMENT_ORDER]), F.col("recruitment_type"))
    return (g.withColumn("_typed", F.sum("postings").over(w))
            .withColumn("postings_share_pct", F.try_divide(F.col("postings") * 100.0, F.col("_typed")))
            .withColumn("tracked_mix_coverage_pct", F.try_divide(F.col("_typed") * 100.0, total))
            .withColumn("type_order", order.cast("int"))
            .drop("_typed").orderBy("type_order"))


def recruitment_trend(finance: DataFrame, s: Scenario = DEFAULT, scope: Column | None = None) -> DataFrame:
    """P-13: month x raw employment type counts, vacancies and exposure."""
    f = reprice(finance, s)
    if scope is not None:
        f = f.where(scope)
    f = f.where(F.col("posting_date").isNotNull() & F.col("employment_type").isNotNull())
    return (f.groupBy(F.trunc("posting_date", "month").alias("posting_month"),
                      F.col("employment_type").alias("recruitment_type"))
            .agg(F.count(F.lit(1)).alias("postings"), F.sum("number_of_vacancies").alias("vacancies"),
                 F.sum("vacancy_budget_exposure").alias("total_budget_exposure"))
            .orderBy("posting_month", "recruitment_type"))


def posting_lag(jobs: DataFrame, new: str = "metadata_newPostingDate", orig: str = "posting_date") -> DataFrame:
    """P-14: days from first to latest posting, floored at 0 (null stays null)."""
    return jobs.select("job_id", clip(F.datediff(new, orig), 0).alias("new_posting_lag_days"))


def scenario_params(spark: SparkSession, s: Scenario = DEFAULT) -> DataFrame:
    """P-15: the scenario as a one-row table."""
    row = s.as_row()
    return spark.createDataFrame([tuple(row.values())], list(row.keys()))
