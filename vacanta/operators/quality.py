"""Data-quality, profiling and lineage operators (Q-01..Q-20, S-07, C-13, C-14).

Every report is one aggregation pass (conditional counts, ``count(DISTINCT)``,
exact percentiles) whose result is a handful of rows; wide one-row results
are turned into long form with ``stack``. Nothing is collected to the driver.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import first_match, scalar
from ..functions.text import INVISIBLE_CLASS, collapse_ws, leading_letters, py_strip, repair
from .clean import DATE_COLS, grouping_key

# ---- fixed values ------------------------------------------------------------
MANY_NULLS = 5
LOSS_CLASSES = [(5, "low"), (10, "moderate")]          # else "high"
ZERO_COLS = ["metadata_totalNumberJobApplication", "metadata_totalNumberOfView",
             "minimumYearsExperience", "numberOfVacancies", "metadata_repostCount"]
OUTLIER_THRESHOLDS = [20_000, 50_000, 100_000, 1_000_000]
IQR_MULTIPLIER = 3
FLOAT32_EXACT_LIMIT = 2 ** 23
# Strict typed cleaning (C-13)
REQUIRED_COLUMNS = ["metadata_originalPostingDate", "metadata_newPostingDate", "metadata_expiryDate",
                    "metadata_jobPostId", "postedCompany_name"]
STRICT_INT_COLUMNS = ["metadata_repostCount", "metadata_totalNumberJobApplication", "metadata_totalNumberOfView",
                      "minimumYearsExperience", "numberOfVacancies"]
STRICT_FLOAT_COLUMNS = ["salary_maximum", "salary_minimum", "average_salary"]
NON_NEGATIVE_COLUMNS = ["average_salary", "salary_minimum", "salary_maximum"]
BOOL_WORDS = {"true": True, "false": False, "1": True, "0": False, "yes": True, "no": False}
# Permissive draft (C-14)
PERMISSIVE_TEXT = ["employmentTypes", "positionLevels", "postedCompany_name", "salary_type", "status_jobStatus", "title"]
PERMISSIVE_NUMERIC = ["salary_minimum", "salary_maximum", "average_salary", "metadata_repostCount",
                      "metadata_totalNumberJobApplication", "metadata_totalNumberOfView",
                      "minimumYearsExperience", "numberOfVacancies"]
UNKNOWN = "Unknown"
# ------------------------------------------------------------------------------


def _stack(wide: DataFrame, names, value_alias: str, name_alias: str = "name") -> DataFrame:
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) AS ({name_alias}, {value_alias})")


def null_count(df: DataFrame, cols=None) -> Column:
    """A-16: number of null fields in the row."""
    cols = cols or df.columns
    return sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))


def raw_with_lineage(raw: DataFrame) -> DataFrame:
    """S-07: raw rows plus ``raw_id``, ``raw_column_count``, ``raw_null_count``.

    raw_id = sha-256 of the row's JSON text plus a row-local unique suffix, so
    identical (ghost) rows still get distinct ids without grouping them into
    one task."""
    cols = raw.columns
    return raw.select(
        "*",
        F.concat(F.sha2(F.to_json(F.struct(*cols)), 256), F.lit("-"),
                 F.monotonically_increasing_id().cast("string")).alias("raw_id"),
        F.lit(len(cols)).alias("raw_column_count"),
        null_count(raw, cols).alias("raw_null_count"))


def raw_quality_report(lineage: DataFrame) -> DataFrame:
    """Q-01: totals, distinct ids, null statistics per record."""
    return lineage.agg(F.count(F.lit(1)).alias("total_raw_records"),
                       F.count_distinct("raw_id").alias("unique_raw_ids"),
                       F.avg("raw_column_count").alias("avg_columns"),
                       F.avg("raw_null_count").alias("avg_nulls_per_record"),
                       F.min("raw_null_count").alias("min_nulls"),
                       F.max("raw_null_count").alias("max_nulls"),
                       F.count(F.when(F.col("raw_null_count") > MANY_NULLS, 1)).alias("records_with_many_nulls"))


def retention_report(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Q-02: raw vs processed counts, loss, retention %, loss class."""
    r = raw.agg(F.count(F.lit(1)).alias("raw_count"))
    p = scalar(processed.agg(F.count(F.lit(1)).alias("processed_count")), "processed_count")
    out = (r.withColumn("processed_count", p)
           .withColumn("records_lost_in_cleaning", F.col("raw_count") - F.col("processed_count")))
    out = out.withColumn("cleaning_retention_pct", F.try_divide(F.col("processed_count") * 100.0, F.col("raw_count")))
    loss = F.try_divide(F.col("records_lost_in_cleaning") * 100.0, F.col("raw_count"))
    return out.withColumn("loss_class", F.when(F.col("records_lost_in_cleaning") <= 0, "none")
                          .otherwise(first_match([(loss < t, c) for t, c in LOSS_CLASSES], "high")))


def trace_ids(ids: DataFrame, raw: DataFrame, jobs: DataFrame, raw_id: str = "metadata_jobPostId") -> DataFrame:
    """Q-03 for asked ids (one column ``id``): found, lost_in_processing or not_found."""
    known = raw.select(F.col(raw_id).alias("id"), F.lit(True).alias("_raw")).distinct()
    done = jobs.select(F.col("job_id").alias("id"), F.lit(True).alias("_job")).distinct()
    out = ids.select("id").join(known, "id", "left").join(done, "id", "left")
    return out.select("id", F.when(F.col("_raw").isNull(), "not_found").when(F.col("_job").isNull(), "lost_in_processing")
                      .otherwise("found").alias("transformation_status"))


def lineage_join(raw: DataFrame, jobs: DataFrame, raw_id: str = "metadata_jobPostId") -> DataFrame:
    """J-08 / Q-03: each raw record joined to its processed row by source id;
    status found / lost_in_processing."""
    j = jobs.select(F.col("job_id"), F.lit(True).alias("_hit"))
    out = raw.join(j, raw[raw_id] == j["job_id"], "left")
    return out.select(raw_id, "job_id",
                      F.when(F.col("_hit"), "found").otherwise("lost_in_processing").alias("transformation_status"))


def lineage_status(raw: DataFrame, jobs: DataFrame) -> DataFrame:
    return lineage_join(raw, jobs).groupBy("transformation_status").agg(F.count(F.lit(1)).alias("records"))


def experience_distribution(jobs: DataFrame) -> DataFrame:
    """Q-04: postings per experience level and percentage of all (unrounded)."""
    g = jobs.groupBy("experience_level").agg(F.count(F.lit(1)).alias("count"))
    total = scalar(jobs.agg(F.count(F.lit(1)).alias("_t")), "_t")
    return g.withColumn("percentage", F.col("count") * 100.0 / total).orderBy(F.desc("count"), "experience_level")


def salary_summary(jobs: DataFrame) -> DataFrame:
    """Q-05: rounded min/avg/median/max of salary_max."""
    x = F.col("salary_max")
    return jobs.agg(F.round(F.min(x)).cast("double").alias("min_salary"), F.round(F.avg(x)).alias("avg_salary"),
                    F.round(F.median(x)).alias("median"), F.round(F.max(x)).cast("double").alias("max_salary"))


def top_sectors(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """Q-05: sectors by postings with rounded mean salary_max (sector breaks ties)."""
    return (jobs.where(F.col("sector").isNotNull()).groupBy("sector")
            .agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("salary_max")).alias("avg_salary"))
            .orderBy(F.desc("count"), "sector").limit(limit))


def _numeric(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType,
                                                                        T.FloatType, T.ShortType, T.ByteType))}


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Q-06: per column type, nulls, null %, distinct values, zeros (numeric).

    Exact counts (the reference's ``nunique``) take one narrow scan per column of ``df``, a
    stored table: its rows shrink to (value, rows) in each task before they are shuffled,
    and no row is expanded. ``approx=True`` is one pass with HyperLogLog++ sketches."""
    num, types = _numeric(df), {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if approx:
        aggs = [F.count(F.lit(1)).alias("__n")]
        for c in df.columns:
            aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.approx_count_distinct(c).alias(f"{c}__distinct"),
                     (F.count_if(F.col(c) == 0) if c in num else F.lit(None).cast("long")).alias(f"{c}__zeros")]
        rows = ", ".join(f"'{c}', '{types[c]}', `{c}__nulls`, `{c}__distinct`, `{c}__zeros`" for c in df.columns)
        long = df.agg(*aggs).selectExpr("__n", f"stack({len(df.columns)}, {rows}) AS (column_name, dtype, nulls, distinct_values, zeros)")
    else:
        parts = []
        for c in df.columns:
            values = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("rows"))
            zeros = F.coalesce(F.sum(F.when(F.col("v") == 0, F.col("rows"))), F.lit(0)) if c in num else F.lit(None).cast("long")
            parts.append(values.agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("__n"), F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("rows"))), F.lit(0)).alias("nulls"),
                F.count("v").alias("distinct_values"), zeros.alias("zeros")))
        long = reduce(lambda a, b: a.unionByName(b), parts)
    return long.withColumn("null_pct", F.try_divide(F.col("nulls") * 100.0, F.col("__n"))).drop("__n")


#: Size of a profile's sketches: 2^14 counters give a standard error under 1 %.
PROFILE_LG_K = 14


def profile_sketches(df: DataFrame) -> DataFrame:
    """Q-06 of one batch in a form that adds up: per column its rows, nulls, zeros and a
    distinct-count sketch. One pass, no row expanded; stored beside the batch."""
    num, aggs = _numeric(df), [F.count(F.lit(1)).alias("__n")]
    for c in df.columns:
        hashed = F.when(F.col(c).isNotNull(), F.xxhash64(c))
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.hll_sketch_agg(hashed, F.lit(PROFILE_LG_K)).alias(f"{c}__sketch"),
                 (F.count_if(F.col(c) == 0) if c in num else F.lit(None).cast("long")).alias(f"{c}__zeros")]
    rows = ", ".join(f"'{c}', __n, `{c}__nulls`, `{c}__zeros`, `{c}__sketch`" for c in df.columns)
    return df.agg(*aggs).selectExpr(f"stack({len(df.columns)}, {rows}) AS (column_name, rows, nulls, zeros, sketch)")


def merged_profile(sketches: DataFrame) -> DataFrame:
    """Q-06 of a table that grew by batches, from its batches' ``profile_sketches`` alone."""
    return sketches.groupBy("column_name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("zeros").alias("zeros"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def null_pattern(df: DataFrame) -> DataFrame:
    """Q-08: histogram of nulls per row."""
    return df.groupBy(null_count(df).alias("nulls_in_row")).agg(F.count(F.lit(1)).alias("rows"))


def id_prefixes(df: DataFrame, id_col: str = "metadata_jobPostId") -> DataFrame:
    """Q-08: rows per leading-letters prefix of the id."""
    return df.groupBy(leading_letters(F.col(id_col)).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"))


def row_quality(df: DataFrame, id_col: str = "metadata_jobPostId") -> DataFrame:
    """Q-09: % of non-null fields per row."""
    n = len(df.columns)
    return df.select(id_col, ((F.lit(n) - null_count(df)) * 100.0 / n).alias("data_quality_score"))


def iqr_fence(df: DataFrame, col: str = "average_salary", k: float = IQR_MULTIPLIER) -> DataFrame:
    """Q-10: q1, q3, fence = q3 + k * IQR and rows above it (two passes: one
    single-row quantile aggregate, read back as a scalar for the count)."""
    q = df.agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    q = q.select(F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
    q = q.withColumn("fence", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    cnt = df.agg(F.count(F.when(F.col(col) > scalar(q, "fence"), 1)).alias("rows_above_fence"))
    return q.withColumn("rows_above_fence", scalar(cnt, "rows_above_fence"))


def float32_loss(df: DataFrame, col: str = "average_salary") -> DataFrame:
    """Q-11: largest absolute change when the value is stored as float32, and
    half-values above 2^23 (not representable in float32)."""
    x = F.col(col)
    return df.agg(F.max(F.abs(x.cast("float").cast("double") - x)).alias("max_abs_error"),
                  F.count(F.when((F.abs(x) > FLOAT32_EXACT_LIMIT) & (x != F.floor(x)), 1)).alias("unrepresentable_halves"))


def zero_inflation(df: DataFrame, cols=ZERO_COLS) -> DataFrame:
    """Q-12: zeros and zero % per numeric column."""
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(F.when(F.col(c) == 0, 1)).alias(c) for c in cols]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return (wide.selectExpr("__n", f"stack({len(cols)}, {pairs}) AS (column_name, zeros)")
            .withColumn("zero_pct", F.col("zeros") * 100.0 / F.col("__n")).drop("__n"))


def zero_exp_mix(df: DataFrame, years: str = "minimumYearsExperience", level: str = "positionLevels") -> DataFrame:
    """Q-12: position-level shares among zero-experience postings vs overall."""
    z = F.coalesce(F.col(years) == 0, F.lit(False))
    g = df.groupBy(level).agg(F.count(F.when(z, 1)).alias("zero_n"), F.count(F.lit(1)).alias("all_n"))
    tot = df.agg(F.count(F.when(z, 1)).alias("zero_t"), F.count(F.lit(1)).alias("all_t"))
    return g.select(level, F.try_divide(F.col("zero_n") * 100.0, scalar(tot, "zero_t")).alias("zero_exp_pct"),
                    (F.col("all_n") * 100.0 / scalar(tot, "all_t")).alias("overall_pct"))


def _content_key(df: DataFrame, with_date: bool, case_fold: bool = True):
    t = F.lower(F.col("title")) if case_fold else F.col("title")
    cols = [t, F.col("postedCompany_name"), F.col("employmentTypes"), F.col("positionLevels"),
            F.col("primary_category"), F.col("salary_minimum"), F.col("salary_maximum"), F.col("numberOfVacancies")]
    if with_date:
        cols.append(F.col("metadata_newPostingDate"))
    return cols


def duplicate_levels(clean: DataFrame) -> DataFrame:
    """Q-13: rows beyond the first under five keys of rising strictness:
    exact row, primary key, content any date, content same day, company +
    title + date. Each key is hashed per row, then one map-side-combined
    count per (level, key) gives sum(n - 1) per level."""
    cols = [c for c in clean.columns]
    keys = {
        "1_exact_row": grouping_key([F.col(c) for c in cols]),
        "2_primary_key": grouping_key([F.col("metadata_jobPostId")]),
        "3_content_any_date": grouping_key(_content_key(clean, False)),
        "4_content_same_day": grouping_key(_content_key(clean, True)),
        "5_company_title_date": grouping_key([F.col("postedCompany_name"), F.lower(F.col("title")),
                                            F.col("metadata_newPostingDate")]),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("level"), v.alias("key")) for k, v in keys.items()])
    e = clean.select(F.explode(arr).alias("k")).select("k.level", "k.key")
    g = e.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"))
    total = scalar(clean.agg(F.count(F.lit(1)).alias("_t")), "_t")
    return (g.groupBy("level").agg(F.sum(F.col("n") - 1).alias("duplicate_rows"))
            .withColumn("pct", F.col("duplicate_rows") * 100.0 / total))


def dup_group_variation(clean: DataFrame) -> DataFrame:
    """Q-14: same-day duplicate groups, their rows, the largest, and how many
    groups differ in views / applications inside the group."""
    d = clean.where(F.col("is_same_day_dup"))
    g = d.groupBy("dup_group_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("metadata_totalNumberOfView").alias("v"),
        F.count_distinct("metadata_totalNumberJobApplication").alias("a"))
    return g.agg(F.count(F.lit(1)).alias("same_day_groups"), F.sum("n").alias("same_day_rows"),
                 F.max("n").alias("largest_group"),
                 F.count(F.when(F.col("v") > 1, 1)).alias("groups_views_differ"),
                 F.count(F.when(F.col("a") > 1, 1)).alias("groups_applications_differ"))


def dup_top_companies(clean: DataFrame, limit: int = 10) -> DataFrame:
    """Q-14: companies with most same-day duplicate rows, with on-behalf share."""
    d = clean.where(F.col("is_same_day_dup"))
    return (d.groupBy("postedCompany_name")
            .agg(F.count(F.lit(1)).alias("dup_rows"),
                 (F.avg(F.col("metadata_isPostedOnBehalf").cast("double")) * 100).alias("on_behalf_pct"))
            .orderBy(F.desc("dup_rows"), "postedCompany_name").limit(limit))


def fold_gain(clean: DataFrame) -> DataFrame:
    """Q-14: duplicate rows found only because titles are compared case-folded."""
    folded = grouping_key(_content_key(clean, True, True))
    cased = grouping_key(_content_key(clean, True, False))
    # Equal cased keys have equal folded keys, so the cased groups add up to the folded ones.
    by_case = clean.groupBy(folded.alias("f"), cased.alias("c")).agg(F.count(F.lit(1)).alias("nc"))
    by_fold = by_case.groupBy("f").agg(F.sum("nc").alias("nf"), F.count_if(F.col("nc") == 1).alias("alone"),
                                       F.sum(F.when(F.col("nc") > 1, F.col("nc")).otherwise(0)).alias("cased"))
    total = [F.when(F.col("nf") > 1, F.col(c)).otherwise(0) for c in ("alone", "nf")]
    return by_fold.agg(F.coalesce(F.sum(total[0]), F.lit(0)).alias("fold_only_rows"),
                       F.coalesce(F.sum(total[1]), F.lit(0)).alias("folded_member_rows"),
                       F.coalesce(F.sum("cased"), F.lit(0)).alias("cased_member_rows"))


def outlier_thresholds(jobs: DataFrame) -> DataFrame:
    """Q-15: rows with salary_max above each threshold, plus overall stats."""
    x = F.col("salary_max")
    return jobs.agg(F.count(F.lit(1)).alias("total_rows"), F.min(x).alias("min_salary_max"),
                    F.max(x).alias("max_salary_max"), F.avg(x).alias("avg_salary_max"),
                    F.median(x).alias("median_salary_max"), F.stddev_samp(x).alias("stddev_salary_max"),
                    *[F.count(F.when(x > t, 1)).alias(f"over_{t}") for t in OUTLIER_THRESHOLDS])


def outlier_top(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """Q-15: the largest salary_max postings (job_id breaks ties)."""
    return (jobs.select("job_id", "title", "company", "salary_min", "salary_max")
            .orderBy(F.desc_nulls_last("salary_max"), "job_id").limit(limit))


def outlier_impact(jobs: DataFrame, ceiling: int = 100_000) -> DataFrame:
    """Q-15: mean salary_max with and without rows above the ceiling."""
    x = F.col("salary_max")
    out = jobs.agg(F.avg(x).alias("avg_with_outliers"), F.avg(F.when(x <= ceiling, x)).alias("avg_without_outliers"),
                   F.count(F.when(x > ceiling, 1)).alias("outlier_rows"), F.count(F.lit(1)).alias("total_rows"))
    return (out.withColumn("pct_rows_are_outliers", F.col("outlier_rows") * 100.0 / F.col("total_rows"))
            .withColumn("avg_inflated_by", F.col("avg_with_outliers") - F.col("avg_without_outliers")))


def text_repair_impact(raw: DataFrame) -> DataFrame:
    """Q-16: rows changed by the repair, rows with invisible characters,
    distinct titles/companies before, after and case-folded.

    Titles and companies are counted once each; the repair and its patterns run on the
    distinct ones, weighted by their rows."""
    def counted(c: str) -> DataFrame:
        return raw.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("x")).agg(F.count(F.lit(1)).alias("n"))

    def weight(cond) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    def distinct(df: DataFrame, x: Column) -> Column:
        return scalar(df.select(x.alias("y")).distinct().agg(F.count("y").alias("k")), "k")
    titles = counted("title").withColumn("r", repair(F.col("x")))
    companies = counted("postedCompany_name").withColumn("r", repair(F.upper("x")))
    company = companies.agg(weight(F.col("x").rlike(INVISIBLE_CLASS)).alias("hidden"), weight(F.col("x") != F.col("r")).alias("changed"),
                            F.count("x").alias("raw"))
    return titles.agg(
        weight(F.col("x") != F.col("r")).alias("title_ws_rows"),
        weight(F.col("x").rlike(INVISIBLE_CLASS)).alias("title_invisible_rows"),
        weight(F.col("x").contains("\u200d")).alias("emoji_zwj_rows"),
        F.count("x").alias("title_distinct_raw")).select(
        "title_ws_rows", "title_invisible_rows", scalar(company, "hidden").alias("company_invisible_rows"), "emoji_zwj_rows",
        "title_distinct_raw", scalar(company, "changed").alias("company_ws_rows"), scalar(company, "raw").alias("company_distinct_raw"),
        distinct(titles, F.col("r")).alias("title_distinct_clean"), distinct(titles, F.lower("r")).alias("title_distinct_folded"),
        distinct(companies, F.col("r")).alias("company_distinct_clean"))


def category_stats(clean: DataFrame, bridge: DataFrame) -> DataFrame:
    """Q-17: distinct categories, assignments, empty lists, multi-category %,
    assignments lost if only the first were kept."""
    b = bridge.agg(F.count_distinct("category").alias("distinct_categories"),
                   F.count(F.lit(1)).alias("assignments"))
    p = clean.agg(F.count(F.lit(1)).alias("postings"),
                  F.count(F.when(F.col("n_categories") == 0, 1)).alias("empty_arrays"),
                  (F.avg((F.col("n_categories") > 1).cast("double")) * 100).alias("multi_pct"))
    out = b.withColumns({c: scalar(p, c) for c in ("postings", "empty_arrays", "multi_pct")})
    return out.withColumn("lost_if_first_only", F.col("assignments") - F.col("postings"))


def top_categories(bridge: DataFrame, limit: int = 10) -> DataFrame:
    return (bridge.groupBy("category").agg(F.count(F.lit(1)).alias("postings"))
            .orderBy(F.desc("postings"), "category").limit(limit))


def date_cross_checks(clean: DataFrame) -> DataFrame:
    """Q-18: original after latest date, expiry on/before latest date, lifespan median/max."""
    n, o, e = (F.col(c) for c in ("metadata_newPostingDate", "metadata_originalPostingDate", "metadata_expiryDate"))
    life = F.datediff(e, n)
    return clean.agg(F.count(F.when(o > n, 1)).alias("orig_after_new"),
                     F.count(F.when(e <= n, 1)).alias("expiry_before_post"),
                     F.median(life).alias("lifespan_median"), F.max(life).alias("lifespan_max"))


def _as_text(df: DataFrame) -> DataFrame:
    """Every column as text, the way a CSV reader without inference sees it."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def strict_type_rules(raw: DataFrame) -> DataFrame:
    """C-13 / Q-19 report: after dropping rows whose required columns are all
    null, the number of values failing each strict rule (0 = holds)."""
    t = _as_text(raw).na.drop(how="all", subset=REQUIRED_COLUMNS)
    rules = {}
    b = F.lower(F.trim(F.col("metadata_isPostedOnBehalf")))
    rules["bool_metadata_isPostedOnBehalf"] = F.count(F.when(b.isNull() | ~b.isin(list(BOOL_WORDS)), 1))
    for c in STRICT_INT_COLUMNS:
        rules[f"int_{c}"] = F.count(F.when(F.col(c).try_cast("double").isNull()
                                           | (F.col(c).try_cast("double") != F.floor(F.col(c).try_cast("double"))), 1))
    for c in STRICT_FLOAT_COLUMNS:
        rules[f"float_{c}"] = F.count(F.when(F.col(c).try_cast("double").isNull(), 1))
    for c in NON_NEGATIVE_COLUMNS:
        rules[f"non_negative_{c}"] = F.count(F.when(F.col(c).try_cast("double") < 0, 1))
    wide = t.agg(*[v.alias(k) for k, v in rules.items()])
    return _stack(wide, list(rules), "violations", "rule")


def strict_clean(raw: DataFrame, check: bool = False) -> DataFrame:
    """C-13: strict typed cleaning. With ``check`` the rule report runs first
    (one aggregation) and any unparseable or negative value raises, as the
    strict chunk cleaner refuses such input."""
    if check:
        from .clean import raise_on_violations
        raise_on_violations(strict_type_rules(raw))
    t = _as_text(raw).na.drop(how="all", subset=REQUIRED_COLUMNS)
    b = F.lower(F.trim(F.col("metadata_isPostedOnBehalf")))
    bool_expr = first_match([(b == k, F.lit(v)) for k, v in BOOL_WORDS.items()], F.lit(None).cast("boolean"))
    out = t.withColumns({c: F.try_to_date(F.col(c), "yyyy-MM-dd") for c in DATE_COLS})
    out = out.withColumn("metadata_isPostedOnBehalf", bool_expr)
    out = out.withColumns({c: F.col(c).try_cast("double").cast("long") for c in STRICT_INT_COLUMNS})
    out = out.withColumns({c: F.col(c).try_cast("double") for c in STRICT_FLOAT_COLUMNS})
    return out.drop("occupationId")


def permissive_clean(raw: DataFrame) -> DataFrame:
    """C-14: the permissive draft: exact-duplicate removal, coerced dates and
    numbers, category names (bad JSON -> empty list), trimmed/collapsed text
    with 'Unknown' for nulls, average salary filled from the range midpoint."""
    from .clean import CATEGORY_SCHEMA
    d = _as_text(raw).dropDuplicates()
    d = d.withColumns({c: F.try_to_date(F.col(c), "yyyy-MM-dd") for c in DATE_COLS})
    parsed = F.from_json(F.col("categories"), CATEGORY_SCHEMA, {"mode": "PERMISSIVE"})
    d = d.withColumn("categories_parsed", F.coalesce(F.transform(parsed, lambda x: x.getField("category")),
                                                     F.array().cast("array<string>")))
    d = d.withColumns({c: F.coalesce(collapse_ws(py_strip(F.col(c))), F.lit(UNKNOWN))
                       for c in PERMISSIVE_TEXT})
    d = d.withColumns({c: F.col(c).try_cast("double") for c in PERMISSIVE_NUMERIC})
    d = d.withColumn("average_salary", F.coalesce(F.col("average_salary"),
                                                  (F.col("salary_minimum") + F.col("salary_maximum")) / 2))
    return d.drop("occupationId")


def finance_rules(finance: DataFrame) -> DataFrame:
    """Q-20: violation counts of the finance prototype's assertions."""
    rules = {
        "midpoint_non_negative": F.count(F.when(F.col("salary_midpoint_monthly") < 0, 1)),
        "salary_type_monthly": F.count(F.when(F.col("salary_type") != "Monthly", 1)),
        "window_non_negative": F.count(F.when(F.col("posting_window_days") < 0, 1)),
        "exposure_non_negative": F.count(F.when(F.col("vacancy_budget_exposure") < 0, 1)),
    }
    return _stack(finance.agg(*[v.alias(k) for k, v in rules.items()]), list(rules), "violations", "rule")


def type_cohort_counts(finance: DataFrame) -> DataFrame:
    """Q-20: postings per raw employment type x cohort."""
    return finance.groupBy("employment_type", "employment_cohort").agg(F.count(F.lit(1)).alias("postings"))


class StepCounts:
    """Q-07 / Q-02 as the data flows: rows, columns and null cells after each watched step,
    counted by the write that the steps are part of; no further scan. Watch rows that no
    shuffle of that write follows: a map task that runs again after a lost executor would
    count twice."""

    def __init__(self):
        self.watched: list[tuple[str, int, Observation]] = []

    def watch(self, step: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self.watched.append((step, len(df.columns), seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(null_count(df)), F.lit(0)).alias("null_cells"))

    def ledger(self, spark) -> DataFrame:
        """(step_no, step, rows, columns, null_cells, rows_removed) once the writes are done."""
        rows, before = [], None
        for i, (step, columns, seen) in enumerate(self.watched):
            n = seen.get["rows"]
            rows.append((i, step, n, columns, seen.get["null_cells"], None if before is None else before - n))
            before = n
        return spark.createDataFrame(rows, "step_no int, step string, rows long, columns int, null_cells long, rows_removed long")


def step_ledger(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """Q-07 (opt-in, one action per step's aggregate): rows, columns and null
    cells after each named step, with rows removed relative to the previous."""
    parts = []
    for i, (name, df) in enumerate(steps):
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), F.sum(null_count(df)).alias("null_cells"))
                     .select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), "rows",
                             F.lit(len(df.columns)).alias("columns"), "null_cells"))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    from pyspark.sql import Window
    w = Window.orderBy("step_no")
    return out.withColumn("rows_removed", F.lag("rows").over(w) - F.col("rows"))
