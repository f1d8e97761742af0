"""Registered cleaning / enrichment / source queries (C-*, E-*, S-*) with their oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import null_safe_corr
from ..operators import clean as C
from ..operators import enrich as E
from ..operators import quality as Q
from ..sources.bind import RAW_COLUMNS
from ..sources.tables import TABLES, scan
from ..functions.text import WHITESPACE_CLASS
from ..session import stored
from .oracle_base import BIND, CLEAN, GHOST_SQL, JOBS, sql_py_strip, with_ctes
from .postings import Postings
from .registry import register

ID = "metadata_jobPostId"
_KEPT = f"NOT ({GHOST_SQL}) AND NOT coalesce(regexp_matches(metadata_jobPostId, '^RANDOM_JOB_'), false)"
_TEXT_RAW = {"categories", "employmentTypes", "metadata_expiryDate", "metadata_jobPostId", "metadata_newPostingDate",
             "metadata_originalPostingDate", "occupationId", "positionLevels", "postedCompany_name", "salary_type",
             "status_jobStatus", "title"}


def _raw(spark, sf):
    return Postings(spark, sf).raw()


def _kept(spark, sf):
    return C.remove_synthetic_rows(C.remove_ghost_rows(_raw(spark, sf)))


def _clean(spark, sf):
    return Postings(spark, sf).clean()


def _r(body: str) -> str:
    return with_ctes(BIND, body=body)


def _c(body: str, *extra: str) -> str:
    return with_ctes(BIND, CLEAN, *extra, body=body)


def _j(body: str, *extra: str) -> str:
    return with_ctes(BIND, CLEAN, JOBS, *extra, body=body)


@register("clean_ghost_rows", _r(f"SELECT {ID}, title FROM raw WHERE NOT ({GHOST_SQL})"))
def q_ghost(spark, sf):
    """C-01."""
    return C.remove_ghost_rows(_raw(spark, sf)).select(ID, "title")


@register("clean_synthetic_rows", _r(f"SELECT {ID} FROM raw WHERE {_KEPT}"))
def q_synthetic(spark, sf):
    """C-02 (after C-01)."""
    return _kept(spark, sf).select(ID)


def _dead_sql() -> str:
    parts = []
    for c in RAW_COLUMNS:
        nb = (f"CAST(coalesce(SUM(CASE WHEN trim(CAST({c} AS VARCHAR)) <> '' THEN 1 ELSE 0 END), 0) AS BIGINT)"
              if c in _TEXT_RAW else f"COUNT({c})")
        parts.append(f"SELECT '{c}' AS column_name, {nb} AS non_blank, COUNT(DISTINCT {c}) <= 1 AS at_most_one_value FROM kept")
    return _r(f"SELECT *, non_blank = 0 OR at_most_one_value AS is_dead FROM ({' UNION ALL '.join(parts)})").replace(
        "\nSELECT *, non_blank", f",\nkept AS (SELECT * FROM raw WHERE {_KEPT})\nSELECT *, non_blank", 1)


@register("dead_column_scan", _dead_sql())
def q_dead(spark, sf):
    """C-03 report on the extract after junk-row removal."""
    return C.dead_column_scan(_kept(spark, sf))


@register("date_roundtrip_check", _r(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NOT NULL AND (TRY_CAST({c} AS DATE) IS NULL "
    f"OR strftime(TRY_CAST({c} AS DATE), '%Y-%m-%d') <> {c})) AS lossy_values FROM raw" for c in C.DATE_COLS)))
def q_dates(spark, sf):
    """C-04 report (0 lossy values on every date column)."""
    return C.date_roundtrip_check(_raw(spark, sf))


@register("category_bridge", _c(f"""SELECT {ID}, CAST(pos - 1 AS INTEGER) AS pos, CAST(c.id AS SMALLINT) AS category_id, c.category AS category
    FROM (SELECT {ID}, unnest(categories) AS c, generate_subscripts(categories, 1) AS pos FROM clean)"""))
def q_bridge(spark, sf):
    """C-05 bridge."""
    return Postings(spark, sf).bridge()


@register("primary_category", _c(f"SELECT {ID}, primary_category, n_categories FROM clean"))
def q_primary(spark, sf):
    """C-05: primary category and count."""
    return _clean(spark, sf).select(ID, "primary_category", "n_categories")


@register("normalize_text", _c(f"SELECT {ID}, title, postedCompany_name FROM clean"))
def q_text(spark, sf):
    """C-06."""
    return _clean(spark, sf).select(ID, "title", "postedCompany_name")


@register("fix_salaries", _c(f"SELECT {ID}, salary_minimum, salary_maximum, salary_flag, average_salary FROM clean"))
def q_salaries(spark, sf):
    """C-07."""
    return _clean(spark, sf).select(ID, "salary_minimum", "salary_maximum", "salary_flag", "average_salary")


@register("salary_flag_counts", _c("SELECT salary_flag, COUNT(*) AS n FROM clean GROUP BY salary_flag"))
def q_flag_counts(spark, sf):
    """C-07 flag distribution."""
    return _clean(spark, sf).groupBy("salary_flag").agg(F.count(F.lit(1)).alias("n"))


@register("cap_experience", _c(f"SELECT {ID}, minimumYearsExperience FROM clean"))
def q_cap(spark, sf):
    """C-07b."""
    return _clean(spark, sf).select(ID, "minimumYearsExperience")


@register("derived_columns", _c(f"SELECT {ID}, listing_days, is_repost, source FROM clean"))
def q_derived(spark, sf):
    """C-07c."""
    return _clean(spark, sf).select(ID, "listing_days", "is_repost", "source")


@register("flag_duplicates", _c(f"SELECT {ID}, dup_group_id, dup_group_size, is_same_day_dup, is_first_seen FROM clean"))
def q_flag_dups(spark, sf):
    """C-08."""
    return _clean(spark, sf).select(ID, "dup_group_id", "dup_group_size", "is_same_day_dup", "is_first_seen")


_RULES_SQL = """SELECT * FROM (VALUES
  ('unique_id', (SELECT COUNT(*) - COUNT(DISTINCT metadata_jobPostId) - CASE WHEN COUNT(metadata_jobPostId) < COUNT(*) THEN 1 ELSE 0 END FROM clean)),
  ('title_not_null', (SELECT COUNT(*) FILTER (WHERE title IS NULL) FROM clean)),
  ('no_synthetic', (SELECT COUNT(*) FILTER (WHERE coalesce(regexp_matches(metadata_jobPostId, '^RANDOM_JOB_'), false)) FROM clean)),
  ('ok_max_in_range', (SELECT COUNT(*) FILTER (WHERE salary_flag = 'ok' AND (salary_maximum IS NULL OR salary_maximum < 500 OR salary_maximum > 100000)) FROM clean)),
  ('ok_min_in_range', (SELECT COUNT(*) FILTER (WHERE salary_flag = 'ok' AND (salary_minimum IS NULL OR salary_minimum < 500 OR salary_minimum > 100000)) FROM clean)),
  ('stipend_in_range', (SELECT COUNT(*) FILTER (WHERE salary_flag = 'low_stipend' AND (salary_maximum IS NULL OR salary_maximum < 300 OR salary_maximum > 500)) FROM clean)),
  ('stipend_is_internship', (SELECT COUNT(*) FILTER (WHERE salary_flag = 'low_stipend' AND NOT coalesce(employmentTypes = 'Internship/Attachment', false)) FROM clean)),
  ('outlier_over_ceiling', (SELECT COUNT(*) FILTER (WHERE salary_flag = 'outlier' AND NOT coalesce(salary_maximum > 100000, false)) FROM clean)),
  ('outlier_not_null', (SELECT COUNT(*) FILTER (WHERE salary_flag = 'outlier' AND salary_maximum IS NULL) FROM clean)),
  ('undisclosed_equals_null', (SELECT abs(COUNT(*) FILTER (WHERE salary_flag = 'undisclosed') - COUNT(*) FILTER (WHERE salary_maximum IS NULL)) FROM clean)),
  ('paired_nulls', (SELECT COUNT(*) FILTER (WHERE (salary_minimum IS NULL) <> (salary_maximum IS NULL)) FROM clean)),
  ('expiry_after_posting', (SELECT COUNT(*) FILTER (WHERE metadata_expiryDate IS NOT NULL AND metadata_newPostingDate IS NOT NULL
                                                   AND NOT (metadata_expiryDate > metadata_newPostingDate)) FROM clean))
) t(rule, violations)"""


@register("validate_rules", _c(_RULES_SQL))
def q_validate(spark, sf):
    """C-09: all 12 post-conditions with violation counts."""
    return C.validate_rules(_clean(spark, sf))


@register("int_range_check", _c(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {b} AS bits, CAST(MIN({c}) AS BIGINT) AS observed_min, CAST(MAX({c}) AS BIGINT) AS observed_max, "
    f"coalesce(MIN({c}) >= -{2 ** (b - 1)} AND MAX({c}) <= {2 ** (b - 1) - 1}, true) AS fits FROM clean"
    for c, b in C.INT_WIDTHS.items())))
def q_int_range(spark, sf):
    """C-10."""
    return C.int_range_check(_clean(spark, sf))


_TXT = "CAST({c} AS VARCHAR)"
_REQ_NULL = " AND ".join(f"{c} IS NULL" for c in Q.REQUIRED_COLUMNS)


def _strict_rules_sql() -> str:
    rows = [("bool_metadata_isPostedOnBehalf",
             "COUNT(*) FILTER (WHERE lower(trim(CAST(metadata_isPostedOnBehalf AS VARCHAR))) IS NULL OR "
             "lower(trim(CAST(metadata_isPostedOnBehalf AS VARCHAR))) NOT IN ('true', 'false', '1', '0', 'yes', 'no'))")]
    for c in Q.STRICT_INT_COLUMNS:
        d = f"TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)"
        rows.append((f"int_{c}", f"COUNT(*) FILTER (WHERE {d} IS NULL OR {d} <> floor({d}))"))
    for c in Q.STRICT_FLOAT_COLUMNS:
        rows.append((f"float_{c}", f"COUNT(*) FILTER (WHERE TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL)"))
    for c in Q.NON_NEGATIVE_COLUMNS:
        rows.append((f"non_negative_{c}", f"COUNT(*) FILTER (WHERE TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) < 0)"))
    body = " UNION ALL ".join(f"SELECT '{n}' AS rule, {e} AS violations FROM st" for n, e in rows)
    return with_ctes(BIND, f"st AS (SELECT * FROM raw WHERE NOT ({_REQ_NULL}))", body=body)


@register("strict_type_rules", _strict_rules_sql())
def q_strict_rules(spark, sf):
    """C-13 / Q-19 rule report."""
    return Q.strict_type_rules(_raw(spark, sf))


def _strict_clean_sql() -> str:
    cols = []
    for c in RAW_COLUMNS:
        if c == "occupationId":
            continue
        t = f"CAST({c} AS VARCHAR)"
        if c in C.DATE_COLS:
            cols.append(f"TRY_CAST({t} AS DATE) AS {c}")
        elif c == "metadata_isPostedOnBehalf":
            b = f"lower(trim({t}))"
            cols.append(f"CASE WHEN {b} IN ('true', '1', 'yes') THEN true WHEN {b} IN ('false', '0', 'no') THEN false END AS {c}")
        elif c in Q.STRICT_INT_COLUMNS:
            cols.append(f"CAST(TRY_CAST({t} AS DOUBLE) AS BIGINT) AS {c}")
        elif c in Q.STRICT_FLOAT_COLUMNS:
            cols.append(f"TRY_CAST({t} AS DOUBLE) AS {c}")
        else:
            cols.append(f"{t} AS {c}")
    return with_ctes(BIND, body=f"SELECT {', '.join(cols)} FROM raw WHERE NOT ({_REQ_NULL})")


@register("strict_clean", _strict_clean_sql())
def q_strict_clean(spark, sf):
    """C-13: strict typed cleaning."""
    return Q.strict_clean(_raw(spark, sf))


def _permissive_sql() -> str:
    cols = []
    for c in RAW_COLUMNS:
        if c == "occupationId":
            continue
        if c in C.DATE_COLS:
            cols.append(f"TRY_CAST({c} AS DATE) AS {c}")
        elif c in Q.PERMISSIVE_TEXT:
            cols.append(f"coalesce(regexp_replace({sql_py_strip(c)}, '{WHITESPACE_CLASS}+', ' ', 'g'), 'Unknown') AS {c}")
        elif c in Q.PERMISSIVE_NUMERIC:
            cols.append(f"TRY_CAST({c} AS DOUBLE) AS {c}")
        else:
            cols.append(c)
    cols.append("coalesce(list_transform(from_json(categories, '[{\"id\":\"INTEGER\",\"category\":\"VARCHAR\"}]'), "
                "lambda x: x.category), []) AS categories_parsed")
    txt = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in RAW_COLUMNS)
    return with_ctes(BIND, f"pt AS (SELECT DISTINCT {txt} FROM raw)",
                     body=f"SELECT * REPLACE (coalesce(average_salary, (salary_minimum + salary_maximum) / 2) AS average_salary) "
                          f"FROM (SELECT {', '.join(cols)} FROM pt)")


@register("permissive_clean", _permissive_sql())
def q_permissive(spark, sf):
    """C-14: permissive cleaning draft."""
    return Q.permissive_clean(_raw(spark, sf))


@register("band_experience", _c(f"""SELECT {ID}, minimumYearsExperience, CASE WHEN minimumYearsExperience IS NULL THEN 'Unknown'
    WHEN minimumYearsExperience <= 1 THEN 'Entry Level' WHEN minimumYearsExperience <= 4 THEN 'Mid Level' ELSE 'Senior' END AS experience_level FROM clean"""))
def q_band_exp(spark, sf):
    """E-01 on the capped years (nulls are Unknown)."""
    return _clean(spark, sf).select(ID, "minimumYearsExperience", E.band_experience("minimumYearsExperience").alias("experience_level"))


@register("band_salary", _c(f"""SELECT {ID}, salary_maximum, CASE WHEN salary_maximum IS NULL THEN 'Unknown' WHEN salary_maximum < 3000 THEN 'Entry (< $3k)'
    WHEN salary_maximum < 5000 THEN 'Mid ($3-5k)' WHEN salary_maximum < 8000 THEN 'Senior ($5-8k)' ELSE 'Executive (> $8k)' END AS salary_band FROM clean"""))
def q_band_salary(spark, sf):
    """E-02 on salary_max."""
    return _clean(spark, sf).select(ID, "salary_maximum", E.band_salary("salary_maximum").alias("salary_band"))


@register("extract_skills", _j("SELECT job_id, skills, skill_count FROM jobs"))
def q_skills(spark, sf):
    """E-03."""
    return Postings(spark, sf).jobs().select("job_id", "skills", "skill_count")


@register("sub_sector", _j("SELECT job_id, sub_sector FROM jobs"))
def q_sub_sector(spark, sf):
    """E-06: second category of the posting's list."""
    return Postings(spark, sf).jobs().select("job_id", "sub_sector")


@register("sub_sector_from_bridge", _j("SELECT job_id, sub_sector FROM jobs"))
def q_sub_sector_bridge(spark, sf):
    """E-06 through the bridge (left join on the position-1 row) -- same result."""
    p = Postings(spark, sf)
    clean = p.clean()
    return E.feature_enrichment(clean, C.category_bridge(clean), store=lambda titles: stored(titles, "titles")).select("job_id", "sub_sector")


@register("competitiveness_score", _j("SELECT job_id, competitiveness_score FROM jobs"))
def q_comp(spark, sf):
    """E-07."""
    return Postings(spark, sf).jobs().select("job_id", "competitiveness_score")


_E10_COLS = ["listing_days", "n_categories", "skill_count", "competitiveness_score", "dup_group_size", "repost_count"]
_E10_TARGETS = ["applications", "views", "vacancies"]


def _e10_sql() -> str:
    parts = []
    for c in _E10_COLS:
        corrs = []
        for t in _E10_TARGETS:
            x = f"CASE WHEN {c} IS NOT NULL AND {t} IS NOT NULL THEN CAST({c} AS DOUBLE) END"
            y = f"CASE WHEN {c} IS NOT NULL AND {t} IS NOT NULL THEN CAST({t} AS DOUBLE) END"
            corrs.append(f"covar_samp({x}, {y}) / NULLIF(stddev_samp({x}) * stddev_samp({y}), 0) AS corr_{t}")
        parts.append(f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS n_distinct, "
                     f"COUNT(*) FILTER (WHERE {c} = 0) * 100.0 / COUNT(*) AS zero_pct, {', '.join(corrs)} FROM jobs")
    return _j(" UNION ALL ".join(parts))


@register("derived_column_value", _e10_sql())
def q_e10(spark, sf):
    """E-10: per derived column, distinct values, zero share and correlation
    with applications, views and vacancies (null-safe Pearson)."""
    j = Postings(spark, sf).jobs()
    wide = j.agg(*[x for c in _E10_COLS for x in (
        F.count_distinct(c).alias(f"{c}__n"), (F.count(F.when(F.col(c) == 0, 1)) * 100.0 / F.count(F.lit(1))).alias(f"{c}__z"),
        *[null_safe_corr(c, t).alias(f"{c}__{t}") for t in _E10_TARGETS])])
    rows = ", ".join(f"'{c}', `{c}__n`, `{c}__z`, " + ", ".join(f"`{c}__{t}`" for t in _E10_TARGETS) for c in _E10_COLS)
    names = ", ".join(["column_name", "n_distinct", "zero_pct", *(f"corr_{t}" for t in _E10_TARGETS)])
    return wide.selectExpr(f"stack({len(_E10_COLS)}, {rows}) AS ({names})")


@register("pruned_jobs", _j(f"SELECT {', '.join(c for c in E.JOBS_COLUMNS)} FROM jobs"))
def q_pruned_jobs(spark, sf):
    """E-10: the fact without the derived columns of little value; the contract's columns stay."""
    pruned = E.prune_low_value(Postings(spark, sf).jobs())
    return pruned.select(*[c for c in pruned.columns if c in E.JOBS_COLUMNS])


_PRUNED_DEAD = ", ".join(f"count(DISTINCT {c}) > 1 AS {c}" for c in RAW_COLUMNS)


@register("live_columns_after_prune", with_ctes(BIND, f"kept AS (SELECT * FROM raw WHERE {_KEPT})",
                                                body=f"SELECT column_name, true AS live FROM (UNPIVOT (SELECT {_PRUNED_DEAD} FROM kept) ON * INTO NAME column_name VALUE live) WHERE live"))
def q_live_columns(spark, sf):
    """C-11 after C-03: the extract without its dead columns passes the check that none is
    left; the columns that it holds."""
    pruned = C.prune_dead_columns(_kept(spark, sf))
    C.assert_no_dead_columns(pruned)
    return C.dead_column_scan(pruned).select("column_name", (~F.col("is_dead")).alias("live"))


@register("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLES))
def q_table_counts(spark, sf):
    """S-11: rows per input table."""
    out = None
    for t in TABLES:
        c = scan(spark, sf, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        out = c if out is None else out.unionByName(c)
    return out


@register("sample_rows", _j("SELECT job_id, title, company, sector FROM jobs ORDER BY job_id LIMIT 10"))
def q_sample(spark, sf):
    """S-12: first rows by key (the limit is the operator)."""
    return Postings(spark, sf).jobs().select("job_id", "title", "company", "sector").orderBy("job_id").limit(10)


@register("dropna_required", _r(f"SELECT {ID} FROM raw WHERE NOT ({_REQ_NULL})"))
def q_dropna(spark, sf):
    """F-09: drop rows whose required columns are all null (how='all')."""
    return _raw(spark, sf).na.drop(how="all", subset=Q.REQUIRED_COLUMNS).select(ID)


@register("dropna_any", _r(f"SELECT {ID} FROM raw WHERE {' AND '.join(f'{c} IS NOT NULL' for c in Q.REQUIRED_COLUMNS)}"))
def q_dropna_any(spark, sf):
    """F-09 with how='any'."""
    return _raw(spark, sf).na.drop(how="any", subset=Q.REQUIRED_COLUMNS).select(ID)
