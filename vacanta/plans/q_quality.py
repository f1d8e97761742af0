"""Registered data-quality / lineage queries (Q-01..Q-20, S-07, J-08) with their oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import quality as Q
from ..sources.bind import RAW_COLUMNS
from .oracle_base import BIND, CLEAN, FIN, JOBS, GHOST_SQL, with_ctes
from .postings import Postings
from .registry import register

ID = "metadata_jobPostId"
_NULLS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in RAW_COLUMNS)
_KEPT = f"NOT ({GHOST_SQL}) AND NOT coalesce(regexp_matches(metadata_jobPostId, '^RANDOM_JOB_'), false)"


def _raw(spark, sf):
    return Postings(spark, sf).raw()


def _clean(spark, sf):
    return Postings(spark, sf).clean()


def _jobs(spark, sf):
    return Postings(spark, sf).jobs()


def _r(body, *extra):
    return with_ctes(BIND, *extra, body=body)


def _c(body, *extra):
    return with_ctes(BIND, CLEAN, *extra, body=body)


def _j(body, *extra):
    return with_ctes(BIND, CLEAN, JOBS, *extra, body=body)


@register("raw_lineage_columns", _r(f"SELECT {ID}, {len(RAW_COLUMNS)} AS raw_column_count, {_NULLS} AS raw_null_count FROM raw"))
def q_raw_lineage(spark, sf):
    """S-07 (the raw_id itself is row-unique, not reproducible by SQL; it is checked by Q-01)."""
    return Q.raw_with_lineage(_raw(spark, sf)).select(ID, "raw_column_count", "raw_null_count")


@register("raw_quality_report", _r(f"""SELECT COUNT(*) AS total_raw_records, COUNT(*) AS unique_raw_ids,
    AVG({len(RAW_COLUMNS)}) AS avg_columns, AVG(n) AS avg_nulls_per_record, MIN(n) AS min_nulls, MAX(n) AS max_nulls,
    COUNT(*) FILTER (WHERE n > {Q.MANY_NULLS}) AS records_with_many_nulls FROM (SELECT {_NULLS} AS n FROM raw)"""))
def q_raw_quality(spark, sf):
    """Q-01 on the S-07 output (unique ids = rows proves raw_id is unique)."""
    return Q.raw_quality_report(Q.raw_with_lineage(_raw(spark, sf)))


@register("retention_report", _j("""SELECT raw_count, processed_count, raw_count - processed_count AS records_lost_in_cleaning,
    processed_count * 100.0 / NULLIF(raw_count, 0) AS cleaning_retention_pct,
    CASE WHEN raw_count - processed_count <= 0 THEN 'none'
         WHEN (raw_count - processed_count) * 100.0 / raw_count < 5 THEN 'low'
         WHEN (raw_count - processed_count) * 100.0 / raw_count < 10 THEN 'moderate' ELSE 'high' END AS loss_class
FROM (SELECT (SELECT COUNT(*) FROM raw) AS raw_count, (SELECT COUNT(*) FROM jobs) AS processed_count)"""))
def q_retention(spark, sf):
    """Q-02."""
    return Q.retention_report(_raw(spark, sf), _jobs(spark, sf))


_LJ = f"""lj AS (SELECT r.{ID}, j.job_id, CASE WHEN j.job_id IS NOT NULL THEN 'found' ELSE 'lost_in_processing' END AS transformation_status
    FROM raw r LEFT JOIN (SELECT job_id FROM jobs) j ON j.job_id = r.{ID})"""


@register("lineage_join", _j("SELECT * FROM lj", _LJ))
def q_lineage_join(spark, sf):
    """J-08: raw -> processed by source id."""
    return Q.lineage_join(_raw(spark, sf), _jobs(spark, sf))


_ASKED = f"""asked AS (SELECT DISTINCT {ID} AS id FROM raw WHERE {ID} IS NOT NULL UNION SELECT DISTINCT 'unknown-' || {ID} FROM raw WHERE {ID} IS NOT NULL)"""


@register("lineage_trace_ids", _j(f"""SELECT id, CASE WHEN id NOT IN (SELECT {ID} FROM raw WHERE {ID} IS NOT NULL) THEN 'not_found'
    WHEN id IN (SELECT job_id FROM jobs WHERE job_id IS NOT NULL) THEN 'found' ELSE 'lost_in_processing' END AS transformation_status FROM asked""", _ASKED))
def q_trace_ids(spark, sf):
    """Q-03 for asked ids: every raw id, and one unknown id made from each."""
    raw = _raw(spark, sf)
    known = raw.where(F.col(ID).isNotNull()).select(F.col(ID).alias("id")).distinct()
    asked = known.union(known.select(F.concat(F.lit("unknown-"), "id")))
    return Q.trace_ids(asked, raw, _jobs(spark, sf))


@register("lineage_status", _j("SELECT transformation_status, COUNT(*) AS records FROM lj GROUP BY 1", _LJ))
def q_lineage_status(spark, sf):
    """Q-03."""
    return Q.lineage_status(_raw(spark, sf), _jobs(spark, sf))


@register("experience_distribution", _j("SELECT experience_level, COUNT(*) AS count, COUNT(*) * 100.0 / SUM(COUNT(*)) OVER () AS percentage FROM jobs GROUP BY 1"))
def q_exp_dist(spark, sf):
    """Q-04 (percentage unrounded)."""
    return Q.experience_distribution(_jobs(spark, sf))


@register("salary_summary", _j("""SELECT CAST(ROUND(MIN(salary_max)) AS DOUBLE) AS min_salary, ROUND(AVG(salary_max)) AS avg_salary,
    ROUND(MEDIAN(salary_max)) AS median, CAST(ROUND(MAX(salary_max)) AS DOUBLE) AS max_salary FROM jobs"""))
def q_salary_summary(spark, sf):
    """Q-05."""
    return Q.salary_summary(_jobs(spark, sf))


@register("top_sectors", _j("SELECT sector, COUNT(*) AS count, ROUND(AVG(salary_max)) AS avg_salary FROM jobs WHERE sector IS NOT NULL "
                            "GROUP BY sector ORDER BY count DESC, sector LIMIT 10"))
def q_top_sectors(spark, sf):
    """Q-05."""
    return Q.top_sectors(_jobs(spark, sf))


_NUMERIC_RAW = {"metadata_repostCount", "metadata_totalNumberJobApplication", "metadata_totalNumberOfView",
                "minimumYearsExperience", "numberOfVacancies", "salary_maximum", "salary_minimum", "status_id", "average_salary"}


@register("column_profile", _r(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls, COUNT(DISTINCT {c}) AS distinct_values, "
    + (f"COUNT(*) FILTER (WHERE {c} = 0)" if c in _NUMERIC_RAW else "CAST(NULL AS BIGINT)")
    + f" AS zeros, COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*) AS null_pct FROM raw" for c in RAW_COLUMNS)))
def q_profile(spark, sf):
    """Q-06 (the Spark type name column is dropped for the comparison)."""
    return Q.column_profile(_raw(spark, sf)).drop("dtype")


@register("null_pattern", _r(f"SELECT {_NULLS} AS nulls_in_row, COUNT(*) AS rows FROM raw GROUP BY 1"))
def q_null_pattern(spark, sf):
    """Q-08."""
    return Q.null_pattern(_raw(spark, sf))


@register("id_prefixes", _r(f"SELECT nullif(regexp_extract({ID}, '^([A-Za-z]+)', 1), '') AS prefix, COUNT(*) AS rows FROM raw GROUP BY 1"))
def q_prefixes(spark, sf):
    """Q-08."""
    return Q.id_prefixes(_raw(spark, sf))


@register("row_quality", _r(f"SELECT {ID}, ({len(RAW_COLUMNS)} - ({_NULLS})) * 100.0 / {len(RAW_COLUMNS)} AS data_quality_score FROM raw"))
def q_row_quality(spark, sf):
    """Q-09."""
    return Q.row_quality(_raw(spark, sf))


@register("iqr_fence", _c("""SELECT q1, q3, q3 + 3 * (q3 - q1) AS fence,
    (SELECT COUNT(*) FROM clean WHERE average_salary > q3 + 3 * (q3 - q1)) AS rows_above_fence
FROM (SELECT quantile_cont(average_salary, 0.25) AS q1, quantile_cont(average_salary, 0.75) AS q3 FROM clean)"""))
def q_iqr(spark, sf):
    """Q-10."""
    return Q.iqr_fence(_clean(spark, sf))


@register("float32_loss", _c(f"""SELECT MAX(abs(CAST(CAST(average_salary AS FLOAT) AS DOUBLE) - average_salary)) AS max_abs_error,
    COUNT(*) FILTER (WHERE abs(average_salary) > {Q.FLOAT32_EXACT_LIMIT} AND average_salary <> floor(average_salary)) AS unrepresentable_halves FROM clean"""))
def q_f32(spark, sf):
    """Q-11."""
    return Q.float32_loss(_clean(spark, sf))


@register("zero_inflation", _c(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} = 0) AS zeros, COUNT(*) FILTER (WHERE {c} = 0) * 100.0 / COUNT(*) AS zero_pct FROM clean"
    for c in Q.ZERO_COLS)))
def q_zero(spark, sf):
    """Q-12."""
    return Q.zero_inflation(_clean(spark, sf))


@register("zero_exp_mix", _c("""SELECT positionLevels,
    COUNT(*) FILTER (WHERE coalesce(minimumYearsExperience = 0, false)) * 100.0 / NULLIF((SELECT COUNT(*) FILTER (WHERE coalesce(minimumYearsExperience = 0, false)) FROM clean), 0) AS zero_exp_pct,
    COUNT(*) * 100.0 / (SELECT COUNT(*) FROM clean) AS overall_pct FROM clean GROUP BY positionLevels"""))
def q_zero_mix(spark, sf):
    """Q-12."""
    return Q.zero_exp_mix(_clean(spark, sf))


def _dup_levels_sql() -> str:
    content = "lower(title), postedCompany_name, employmentTypes, positionLevels, primary_category, salary_minimum, salary_maximum, numberOfVacancies"
    keys = [("1_exact_row", "*"), ("2_primary_key", ID), ("3_content_any_date", content),
            ("4_content_same_day", content + ", metadata_newPostingDate"),
            ("5_company_title_date", "postedCompany_name, lower(title), metadata_newPostingDate")]
    parts = [f"SELECT '{n}' AS level, CAST((SELECT COUNT(*) FROM clean) - (SELECT COUNT(*) FROM (SELECT DISTINCT {k} FROM clean)) AS BIGINT) AS duplicate_rows"
             for n, k in keys]
    return _c(f"SELECT *, duplicate_rows * 100.0 / (SELECT COUNT(*) FROM clean) AS pct FROM ({' UNION ALL '.join(parts)})")


@register("duplicate_levels", _dup_levels_sql())
def q_dup_levels(spark, sf):
    """Q-13."""
    return Q.duplicate_levels(_clean(spark, sf))


@register("dup_group_variation", _c("""SELECT COUNT(*) AS same_day_groups, CAST(SUM(n) AS BIGINT) AS same_day_rows, MAX(n) AS largest_group,
    COUNT(*) FILTER (WHERE v > 1) AS groups_views_differ, COUNT(*) FILTER (WHERE a > 1) AS groups_applications_differ
FROM (SELECT dup_group_id, COUNT(*) AS n, COUNT(DISTINCT metadata_totalNumberOfView) AS v, COUNT(DISTINCT metadata_totalNumberJobApplication) AS a
      FROM clean WHERE is_same_day_dup GROUP BY dup_group_id)"""))
def q_dup_var(spark, sf):
    """Q-14 / C-08 summary."""
    return Q.dup_group_variation(_clean(spark, sf))


@register("dup_top_companies", _c("""SELECT postedCompany_name, COUNT(*) AS dup_rows, AVG(CAST(metadata_isPostedOnBehalf AS DOUBLE)) * 100 AS on_behalf_pct
    FROM clean WHERE is_same_day_dup GROUP BY 1 ORDER BY dup_rows DESC, postedCompany_name LIMIT 10"""))
def q_dup_top(spark, sf):
    """Q-14."""
    return Q.dup_top_companies(_clean(spark, sf))


@register("fold_gain", _c("""SELECT COUNT(*) FILTER (WHERE nf > 1 AND nc <= 1) AS fold_only_rows, COUNT(*) FILTER (WHERE nf > 1) AS folded_member_rows,
    COUNT(*) FILTER (WHERE nc > 1) AS cased_member_rows
FROM (SELECT COUNT(*) OVER (PARTITION BY lower(title), postedCompany_name, employmentTypes, positionLevels, primary_category, salary_minimum, salary_maximum, numberOfVacancies, metadata_newPostingDate) AS nf,
             COUNT(*) OVER (PARTITION BY title, postedCompany_name, employmentTypes, positionLevels, primary_category, salary_minimum, salary_maximum, numberOfVacancies, metadata_newPostingDate) AS nc
      FROM clean)"""))
def q_fold_gain(spark, sf):
    """Q-14: value of case folding the title."""
    return Q.fold_gain(_clean(spark, sf))


@register("outlier_thresholds", _j(f"""SELECT COUNT(*) AS total_rows, MIN(salary_max) AS min_salary_max, MAX(salary_max) AS max_salary_max,
    AVG(salary_max) AS avg_salary_max, MEDIAN(salary_max) AS median_salary_max, STDDEV_SAMP(salary_max) AS stddev_salary_max,
    {", ".join(f"COUNT(*) FILTER (WHERE salary_max > {t}) AS over_{t}" for t in Q.OUTLIER_THRESHOLDS)} FROM jobs"""))
def q_out_thr(spark, sf):
    """Q-15."""
    return Q.outlier_thresholds(_jobs(spark, sf))


@register("outlier_top", _j("SELECT job_id, title, company, salary_min, salary_max FROM jobs ORDER BY salary_max DESC NULLS LAST, job_id LIMIT 20"))
def q_out_top(spark, sf):
    """Q-15."""
    return Q.outlier_top(_jobs(spark, sf))


@register("outlier_impact", _j("""SELECT *, outlier_rows * 100.0 / total_rows AS pct_rows_are_outliers, avg_with_outliers - avg_without_outliers AS avg_inflated_by
FROM (SELECT AVG(salary_max) AS avg_with_outliers, AVG(salary_max) FILTER (WHERE salary_max <= 100000) AS avg_without_outliers,
             COUNT(*) FILTER (WHERE salary_max > 100000) AS outlier_rows, COUNT(*) AS total_rows FROM jobs)"""))
def q_out_impact(spark, sf):
    """Q-15."""
    return Q.outlier_impact(_jobs(spark, sf))


def _text_impact_sql() -> str:
    from .oracle_base import sql_repair
    tr, cr = sql_repair("title"), sql_repair("upper(postedCompany_name)")
    inv = "'[\\x{200B}\\x{200E}\\x{200F}\\x{2060}\\x{FEFF}]'"
    return _r(f"""SELECT COUNT(*) FILTER (WHERE title <> {tr}) AS title_ws_rows,
    COUNT(*) FILTER (WHERE regexp_matches(title, {inv})) AS title_invisible_rows,
    COUNT(*) FILTER (WHERE regexp_matches(postedCompany_name, {inv})) AS company_invisible_rows,
    COUNT(*) FILTER (WHERE contains(title, chr(8205))) AS emoji_zwj_rows,
    COUNT(DISTINCT title) AS title_distinct_raw,
    COUNT(*) FILTER (WHERE postedCompany_name <> {cr}) AS company_ws_rows,
    COUNT(DISTINCT postedCompany_name) AS company_distinct_raw,
    COUNT(DISTINCT {tr}) AS title_distinct_clean, COUNT(DISTINCT lower({tr})) AS title_distinct_folded,
    COUNT(DISTINCT {cr}) AS company_distinct_clean FROM raw WHERE {_KEPT}""")


@register("text_repair_impact", _text_impact_sql())
def q_text_impact(spark, sf):
    """Q-16 on the extract after junk-row removal."""
    return Q.text_repair_impact(C.remove_synthetic_rows(C.remove_ghost_rows(_raw(spark, sf))))


_BR = f"br AS (SELECT {ID}, unnest(categories).category AS category FROM clean)"


@register("category_stats", _c("""SELECT (SELECT COUNT(DISTINCT category) FROM br) AS distinct_categories, (SELECT COUNT(*) FROM br) AS assignments,
    COUNT(*) AS postings, COUNT(*) FILTER (WHERE n_categories = 0) AS empty_arrays, AVG(CAST(n_categories > 1 AS DOUBLE)) * 100 AS multi_pct,
    (SELECT COUNT(*) FROM br) - COUNT(*) AS lost_if_first_only FROM clean""", _BR))
def q_cat_stats(spark, sf):
    """Q-17."""
    p = Postings(spark, sf)
    return Q.category_stats(p.clean(), p.bridge())


@register("top_categories", _c("SELECT category, COUNT(*) AS postings FROM br GROUP BY 1 ORDER BY postings DESC, category LIMIT 10", _BR))
def q_top_cats(spark, sf):
    """Q-17."""
    return Q.top_categories(Postings(spark, sf).bridge())


@register("date_cross_checks", _c("""SELECT COUNT(*) FILTER (WHERE metadata_originalPostingDate > metadata_newPostingDate) AS orig_after_new,
    COUNT(*) FILTER (WHERE metadata_expiryDate <= metadata_newPostingDate) AS expiry_before_post,
    MEDIAN(date_diff('day', metadata_newPostingDate, metadata_expiryDate)) AS lifespan_median,
    CAST(MAX(date_diff('day', metadata_newPostingDate, metadata_expiryDate)) AS INTEGER) AS lifespan_max FROM clean"""))
def q_dates_x(spark, sf):
    """Q-18."""
    return Q.date_cross_checks(_clean(spark, sf))


@register("finance_rules", with_ctes(BIND, CLEAN, JOBS, FIN, body="""SELECT * FROM (VALUES
  ('midpoint_non_negative', (SELECT COUNT(*) FILTER (WHERE salary_midpoint_monthly < 0) FROM finance)),
  ('salary_type_monthly', (SELECT COUNT(*) FILTER (WHERE salary_type <> 'Monthly') FROM finance)),
  ('window_non_negative', (SELECT COUNT(*) FILTER (WHERE posting_window_days < 0) FROM finance)),
  ('exposure_non_negative', (SELECT COUNT(*) FILTER (WHERE vacancy_budget_exposure < 0) FROM finance))) t(rule, violations)"""))
def q_fin_rules(spark, sf):
    """Q-20."""
    return Q.finance_rules(Postings(spark, sf).finance())


@register("type_cohort_counts", with_ctes(BIND, CLEAN, JOBS, FIN, body="SELECT employment_type, employment_cohort, COUNT(*) AS postings FROM finance GROUP BY 1, 2"))
def q_type_cohort(spark, sf):
    """Q-20."""
    return Q.type_cohort_counts(Postings(spark, sf).finance())


@register("step_ledger", _j(f"""SELECT * , lag(rows) OVER (ORDER BY step_no) - rows AS rows_removed FROM (
    SELECT 0 AS step_no, 'raw' AS step, COUNT(*) AS rows, {len(RAW_COLUMNS)} AS columns FROM raw
    UNION ALL SELECT 1, 'ghost rows removed', COUNT(*), {len(RAW_COLUMNS)} FROM raw WHERE NOT ({GHOST_SQL})
    UNION ALL SELECT 2, 'synthetic rows removed', COUNT(*), {len(RAW_COLUMNS)} FROM raw WHERE {_KEPT}
    UNION ALL SELECT 3, 'deduplicated', COUNT(*), 23 FROM deduped)"""))
def q_ledger(spark, sf):
    """Q-07: rows and columns per step (null cells are reported by the operator, not compared)."""
    raw = _raw(spark, sf)
    g = C.remove_ghost_rows(raw)
    s = C.remove_synthetic_rows(g)
    from ..operators.enrich import JOBS_COLUMNS
    d = Postings(spark, sf).deduped().select(*JOBS_COLUMNS)
    return Q.step_ledger([("raw", raw), ("ghost rows removed", g), ("synthetic rows removed", s),
                          ("deduplicated", d)]).drop("null_cells")


def _doc_impact_sql() -> str:
    from .oracle_base import sql_repair
    tr = sql_repair("text")
    inv = "'[\\x{200B}\\x{200E}\\x{200F}\\x{2060}\\x{FEFF}]'"
    return f"""SELECT COUNT(*) FILTER (WHERE text <> {tr}) AS text_changed_rows,
    COUNT(*) FILTER (WHERE regexp_matches(text, {inv})) AS invisible_rows,
    CAST(SUM(length(text) - length(regexp_replace(text, {inv}, '', 'g'))) AS BIGINT) AS invisible_chars,
    CAST(SUM(length(text) - length({tr})) AS BIGINT) AS chars_removed,
    COUNT(DISTINCT text) AS distinct_raw, COUNT(DISTINCT {tr}) AS distinct_repaired,
    COUNT(DISTINCT lower({tr})) AS distinct_folded FROM documents"""


@register("text_repair_documents", _doc_impact_sql())
def q_doc_text_impact(spark, sf):
    """Q-16 at volume: the title/company text repair applied to every whole
    document text (invisible characters, whitespace runs, case folding).
    Distinct texts are counted by their 128-bit md5, so the distinct-count
    shuffle moves 32-byte digests instead of whole documents."""
    from ..functions.text import INVISIBLE_CLASS, repair
    from ..sources.tables import scan
    docs = scan(spark, sf, "documents", "text").withColumn("r", repair(F.col("text")))
    t, tr = F.col("text"), F.col("r")
    return docs.agg(
        F.count(F.when(t != tr, 1)).alias("text_changed_rows"),
        F.count(F.when(t.rlike(INVISIBLE_CLASS), 1)).alias("invisible_rows"),
        F.sum(F.length(t) - F.length(F.regexp_replace(t, INVISIBLE_CLASS, ""))).cast("long").alias("invisible_chars"),
        F.sum(F.length(t) - F.length(tr)).cast("long").alias("chars_removed"),
        F.count_distinct(F.md5(t)).alias("distinct_raw"), F.count_distinct(F.md5(tr)).alias("distinct_repaired"),
        F.count_distinct(F.md5(F.lower(tr))).alias("distinct_folded"))
