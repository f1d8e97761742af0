"""Candidate-side operators (K-01..K-09, F-03/F-04). Not deduplicated.

Percentile ranks are computed on a (slice, value) histogram: one shuffle that
collapses repeated values, then a running sum over distinct values per slice
-- never a window over every row of a slice, which would put a hot slice into
one task.
"""
from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import all_of, first_match
from .enrich import job_label_title

# ---- fixed values ------------------------------------------------------------
SEEKER_SALARY_FLOOR = 500
SEEKER_SALARY_CEILING = 100_000
SEEKER_MAX_YEARS = 30
MIN_BENCHMARK_SAMPLE = 200
MIN_SKILL_POSTINGS = 10
TOP_SKILLS = 15
NO_SKILLS = "Not Specified"
POSITION_CLASSES = [(70, "above"), (40, "middle")]   # else "below"
# ------------------------------------------------------------------------------


def seeker_filter(sector=None, experience_level=None, seniority_years=None, use_flag: bool = False) -> Column:
    """F-03 (F-04 with ``use_flag``): dated postings with plausible disclosed pay
    and at most 30 years asked; optional slice filters."""
    conds = [F.col("posting_date").isNotNull(), F.col("salary_min").isNotNull(), F.col("salary_max").isNotNull(),
             F.col("salary_min") >= SEEKER_SALARY_FLOOR, F.col("salary_max") <= SEEKER_SALARY_CEILING,
             F.col("seniority_years").isNull() | (F.col("seniority_years") <= SEEKER_MAX_YEARS)]
    if use_flag:
        conds.insert(0, F.col("salary_flag") == "ok")
    if sector:
        conds.append(F.col("sector") == F.lit(sector))
    if experience_level:
        conds.append(F.col("experience_level") == F.lit(experience_level))
    if seniority_years is not None:
        conds.append(F.col("seniority_years") == int(seniority_years))
    return all_of(conds)


def seeker_base(jobs: DataFrame, sector=None, experience_level=None, seniority_years=None) -> DataFrame:
    """F-03 scan: the filtered postings with ``market_salary`` = (min + max) / 2.
    ``use_flag`` is switched on automatically when the fact carries salary_flag
    only in the F-04 variant (``seeker_base_flagged``)."""
    return (jobs.where(seeker_filter(sector, experience_level, seniority_years))
            .withColumn("market_salary", (F.col("salary_min") + F.col("salary_max")) / 2.0))


def seeker_base_flagged(jobs: DataFrame, **kw) -> DataFrame:
    """F-04: same, plus salary_flag = 'ok' when the column exists."""
    use = "salary_flag" in jobs.columns
    return (jobs.where(seeker_filter(use_flag=use, **kw))
            .withColumn("market_salary", (F.col("salary_min") + F.col("salary_max")) / 2.0))


def title_labels(df: DataFrame, title: str = "title") -> DataFrame:
    """E-05 lookup table: one row per distinct title with its title-only label."""
    return (df.where(F.col(title).isNotNull()).select(title).distinct()
            .withColumn("job_label", job_label_title(title)))


def headline(base: DataFrame) -> DataFrame:
    """K-01: opportunities, sectors hiring, median market salary (rounded
    half-even), top salary."""
    return base.agg(F.count(F.lit(1)).alias("total_opportunities"),
                    F.count_distinct("sector").alias("sectors_hiring"),
                    F.bround(F.median("market_salary"), 0).alias("median_salary"),
                    F.max("salary_max").alias("top_salary"))


def top_titles(base: DataFrame, limit: int = 10) -> DataFrame:
    """K-02: the ``limit`` titles with most postings (title breaks ties), with
    mean market salary, min salary_min, distinct companies and the title label.
    The label is computed after truncating to the top titles."""
    t = (base.where(F.col("title").isNotNull()).groupBy("title").agg(F.count(F.lit(1)).alias("opportunities"),
                                   F.avg("market_salary").alias("avg_salary"),
                                   F.min("salary_min").alias("min_salary"),
                                   F.count_distinct("company").alias("num_companies"))
         .orderBy(F.desc("opportunities"), F.asc_nulls_last("title")).limit(limit))
    return t.withColumn("job_label", job_label_title("title"))


def top_roles_by_label(top: DataFrame) -> DataFrame:
    """K-02 regroup: per label, summed postings and companies, unweighted mean salary."""
    return (top.groupBy("job_label").agg(F.sum("opportunities").alias("opportunities"),
                                         F.avg("avg_salary").alias("avg_salary"),
                                         F.sum("num_companies").alias("num_companies"))
            .orderBy(F.desc("opportunities"), F.asc_nulls_last("job_label")))


def label_benchmarks(base: DataFrame, min_total: int = MIN_BENCHMARK_SAMPLE) -> DataFrame:
    """K-03: per title x experience level: mean salary_min ('median_entry'),
    mean salary_max ('median_max'), max salary_max ('p90'), market-salary p25
    (half-even); then per label x level: unweighted means, max, summed counts;
    labels whose total count is under ``min_total`` are dropped. (The column
    names are the reference's; 'median_*' are means and 'p90' is a max.)"""
    b = base.where(F.col("title").isNotNull() & F.col("experience_level").isNotNull())
    t = b.groupBy("title", "experience_level").agg(
        F.avg("salary_min").alias("median_entry"), F.avg("salary_max").alias("median_max"),
        F.max("salary_max").alias("p90"), F.count(F.lit(1)).alias("count_samples"),
        F.bround(F.percentile("market_salary", F.lit(0.25)), 0).alias("p25"))
    lab = (t.withColumn("job_label", job_label_title("title"))
           .groupBy("job_label", "experience_level")
           .agg(F.avg("p25").alias("p25"), F.avg("median_entry").alias("median_entry"),
                F.avg("median_max").alias("median_max"), F.max("p90").alias("p90"),
                F.sum("count_samples").alias("count_samples")))
    w = Window.partitionBy("job_label")
    return (lab.withColumn("_tot", F.sum("count_samples").over(w)).where(F.col("_tot") >= min_total).drop("_tot")
            .orderBy(F.desc_nulls_last("median_max"), "job_label", "experience_level"))


def competitive_skills(base: DataFrame, min_postings: int = MIN_SKILL_POSTINGS, limit: int = TOP_SKILLS) -> DataFrame:
    """K-04: filter postings with skills first, explode the comma list, mean
    market salary per skill with more than ``min_postings`` postings, top ``limit``."""
    s = base.where(F.col("skills").isNotNull() & (F.col("skills") != NO_SKILLS))
    e = (s.select(F.explode(F.split("skills", ",")).alias("skill"), "salary_min", "salary_max")
         .withColumn("skill", F.trim("skill"))
         .where((F.col("skill") != "") & (F.col("skill") != NO_SKILLS)))
    return (e.groupBy("skill").agg(F.count(F.lit(1)).alias("opportunities"),
                                   F.avg((F.col("salary_min") + F.col("salary_max")) / 2.0).alias("avg_salary"))
            .where(F.col("opportunities") > min_postings)
            .orderBy(F.desc("avg_salary"), "skill").limit(limit))


def position_class(pct: Column) -> Column:
    return first_match([(pct >= t, lbl) for t, lbl in POSITION_CLASSES], F.when(pct.isNotNull(), F.lit("below")))


def salary_percentile(base: DataFrame, requests: DataFrame, slice_cols=("sector", "experience_level"),
                      decimals: int | None = 1) -> DataFrame:
    """K-05 (batch form): for each distinct request (slice values + ``salary``),
    the share (%) of the slice's postings with market salary <= salary, the
    slice size and the position class (empty slice: null percentile, 0 size). A slice
    value that is not set (null) means all postings, as an unset filter does.

    Implemented on a histogram: counts per (slice, value), expanded to the slices that
    unset values make, with the requests merged in as zero-weight rows; one running sum
    per slice over distinct values (requests sort after equal values) gives each request
    its count."""
    keys = list(slice_cols)
    base_hist = base.groupBy(*keys, F.col("market_salary").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    masks = F.array(*[F.struct(*[(F.col(k) if on else F.lit(None).cast(base.schema[k].dataType)).alias(k) for k, on in zip(keys, ons)],
                               F.lit("".join(map(str, ons))).alias("set"))
                      for ons in itertools.product((0, 1), repeat=len(keys))])
    hist = (base_hist.select(F.explode(masks).alias("s"), "v", "w").select("s.*", "v", "w")
            .groupBy("set", *keys, "v").agg(F.sum("w").alias("w"))
            .withColumn("is_req", F.lit(0)).withColumn("salary", F.lit(None).cast("double")))
    req = (requests.select(*keys, F.col("salary").cast("double").alias("salary")).distinct()
           .select(F.concat(*[F.col(k).isNotNull().cast("int").cast("string") for k in keys]).alias("set"), *keys,
                   F.col("salary").alias("v"), F.lit(0).cast("long").alias("w"), F.lit(1).alias("is_req"), "salary"))
    u = hist.unionByName(req)
    run = Window.partitionBy("set", *keys).orderBy("v", "is_req").rowsBetween(Window.unboundedPreceding, 0)
    u = (u.withColumn("lower_count", F.sum("w").over(run))
         .withColumn("comparable_postings", F.sum("w").over(Window.partitionBy("set", *keys))))
    out = (u.where(F.col("is_req") == 1).select(*keys, "salary", "lower_count", "comparable_postings")
           .withColumn("percentile", F.try_divide(100.0 * F.col("lower_count"),
                                                  F.nullif(F.col("comparable_postings"), F.lit(0)))))
    if decimals is not None:
        out = out.withColumn("percentile", F.bround("percentile", decimals))
    return out.withColumn("position", position_class(F.col("percentile")))


def pay_by_years(base: DataFrame) -> DataFrame:
    """K-06: median market salary per required-years value (half-even)."""
    return (base.where(F.col("seniority_years").isNotNull()).groupBy("seniority_years")
            .agg(F.bround(F.median("market_salary"), 0).alias("median_salary")).orderBy("seniority_years"))


def seniority_ladder(base: DataFrame) -> DataFrame:
    """K-07: median market salary per position level (null -> Unspecified)."""
    return (base.withColumn("position_level", F.coalesce(F.col("position_level"), F.lit("Unspecified")))
            .groupBy("position_level").agg(F.bround(F.median("market_salary"), 0).alias("median_salary"))
            .orderBy(F.desc_nulls_last("median_salary"), "position_level"))


def pay_range_width(base: DataFrame, limit: int = 10) -> DataFrame:
    """K-08: p90 - p10 of market salary per sector x experience level, top ``limit``."""
    b = base.where(F.col("sector").isNotNull() & F.col("experience_level").isNotNull())
    q = F.percentile("market_salary", F.array(F.lit(0.1), F.lit(0.9)))
    return (b.groupBy("sector", "experience_level").agg(q.alias("_q"))
            .select("sector", "experience_level", F.bround(F.col("_q")[1] - F.col("_q")[0], 0).alias("pay_range"))
            .orderBy(F.desc("pay_range"), "sector", "experience_level").limit(limit))


def competition_high_low(base: DataFrame, limit: int = 10) -> DataFrame:
    """K-09: postings per vacancy by title (0 vacancies -> null), regrouped by
    label (summed postings, unweighted means); the top ceil(limit/2) labels by
    ratio labelled High and the bottom floor(limit/2) labelled Low."""
    t = (base.where(F.col("title").isNotNull()).groupBy("title").agg(F.count(F.lit(1)).alias("postings"), F.sum("vacancies").alias("vacancies"),
                                   F.median("market_salary").alias("median_salary"))
         .withColumn("competition_ratio", F.try_divide(F.col("postings").cast("double"),
                                                       F.nullif(F.col("vacancies"), F.lit(0)))))
    lab = (t.withColumn("job_label", job_label_title("title"))
           .groupBy("job_label").agg(F.sum("postings").alias("postings"),
                                     F.avg("competition_ratio").alias("competition_ratio"),
                                     F.avg("median_salary").alias("median_salary")))
    n_high = limit // 2 + limit % 2
    high = (lab.orderBy(F.desc_nulls_last("competition_ratio"), F.desc("postings"), F.asc_nulls_last("job_label"))
            .limit(n_high).withColumn("competition_type", F.lit("High")))
    low = (lab.orderBy(F.asc_nulls_last("competition_ratio"), F.desc("postings"), F.asc_nulls_last("job_label"))
           .limit(limit // 2).withColumn("competition_type", F.lit("Low")))
    return high.unionByName(low)
