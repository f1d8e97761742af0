"""Registered seeker queries (F-03/F-04, K-01..K-09, E-05) with their oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import seeker as K
from .oracle_base import BIND, CLEAN, JOBS, sql_job_label, with_ctes
from .postings import Postings
from .registry import register

_SB_WHERE = ("posting_date IS NOT NULL AND salary_min IS NOT NULL AND salary_max IS NOT NULL "
             "AND salary_min >= 500 AND salary_max <= 100000 AND (seniority_years IS NULL OR seniority_years <= 30)")
SB = f"""sb AS (SELECT *, (salary_min + salary_max) / 2.0 AS market_salary FROM jobs WHERE {_SB_WHERE}),
tl AS (SELECT DISTINCT title, {sql_job_label("title")} AS job_label FROM sb WHERE title IS NOT NULL)"""


def _sql(*extra: str, body: str) -> str:
    return with_ctes(BIND, CLEAN, JOBS, SB, *extra, body=body)


def _b(spark, sf):
    return K.seeker_base(Postings(spark, sf).jobs())


@register("seeker_base", _sql(body="SELECT job_id, market_salary FROM sb"))
def q_seeker_base(spark, sf):
    """F-03."""
    return _b(spark, sf).select("job_id", "market_salary")


@register("seeker_base_flagged", _sql(body=f"SELECT job_id, (salary_min + salary_max) / 2.0 AS market_salary FROM jobs "
                                           f"WHERE salary_flag = 'ok' AND {_SB_WHERE}"))
def q_seeker_base_flagged(spark, sf):
    """F-04: with salary_flag = 'ok' because the fact carries the column."""
    return K.seeker_base_flagged(Postings(spark, sf).jobs()).select("job_id", "market_salary")


@register("job_label_title", _sql(body="SELECT title, job_label FROM tl"))
def q_job_label_title(spark, sf):
    """E-05: title-only label per distinct title."""
    return K.title_labels(_b(spark, sf))


@register("job_label_full", with_ctes(BIND, CLEAN, JOBS, body="SELECT job_id, job_label FROM jobs"))
def q_job_label_full(spark, sf):
    """E-04: label from title, level and company on every posting."""
    return Postings(spark, sf).jobs().select("job_id", "job_label")


@register("seeker_headline", _sql(body="""SELECT COUNT(*) AS total_opportunities, COUNT(DISTINCT sector) AS sectors_hiring,
    round_even(MEDIAN(market_salary), 0) AS median_salary, MAX(salary_max) AS top_salary FROM sb"""))
def q_seeker_headline(spark, sf):
    """K-01."""
    return K.headline(_b(spark, sf))


_TOP = """tt AS (
    SELECT t.*, tl.job_label FROM (
        SELECT title, COUNT(*) AS opportunities, AVG(market_salary) AS avg_salary, MIN(salary_min) AS min_salary,
               COUNT(DISTINCT company) AS num_companies
        FROM sb WHERE title IS NOT NULL GROUP BY title ORDER BY opportunities DESC, title NULLS LAST LIMIT 10) t
    LEFT JOIN tl USING (title))"""


@register("top_titles", _sql(_TOP, body="SELECT * FROM tt"))
def q_top_titles(spark, sf):
    """K-02."""
    return K.top_titles(_b(spark, sf))


@register("top_roles_by_label", _sql(_TOP, body="""SELECT job_label, CAST(SUM(opportunities) AS BIGINT) AS opportunities,
    AVG(avg_salary) AS avg_salary, CAST(SUM(num_companies) AS BIGINT) AS num_companies FROM tt GROUP BY job_label"""))
def q_top_roles_by_label(spark, sf):
    """K-02 regrouped by label."""
    return K.top_roles_by_label(K.top_titles(_b(spark, sf)))


@register("label_benchmarks", _sql("""lbt AS (
    SELECT title, experience_level, AVG(salary_min) AS median_entry, AVG(salary_max) AS median_max, MAX(salary_max) AS p90,
           COUNT(*) AS count_samples, round_even(quantile_cont(market_salary, 0.25), 0) AS p25
    FROM sb WHERE title IS NOT NULL AND experience_level IS NOT NULL GROUP BY title, experience_level)""",
    """lbl AS (
    SELECT job_label, experience_level, AVG(p25) AS p25, AVG(median_entry) AS median_entry, AVG(median_max) AS median_max,
           MAX(p90) AS p90, CAST(SUM(count_samples) AS BIGINT) AS count_samples
    FROM lbt JOIN tl USING (title) GROUP BY job_label, experience_level)""",
    body=f"SELECT * FROM lbl WHERE job_label IN (SELECT job_label FROM lbl GROUP BY job_label HAVING SUM(count_samples) >= {K.MIN_BENCHMARK_SAMPLE})"))
def q_label_benchmarks(spark, sf):
    """K-03."""
    return K.label_benchmarks(_b(spark, sf))


@register("competitive_skills", _sql(body=f"""SELECT skill, COUNT(*) AS opportunities, AVG((salary_min + salary_max) / 2.0) AS avg_salary
    FROM (SELECT trim(unnest(string_split(skills, ','))) AS skill, salary_min, salary_max FROM sb
          WHERE skills IS NOT NULL AND skills <> 'Not Specified')
    WHERE skill <> '' AND skill <> 'Not Specified'
    GROUP BY skill HAVING COUNT(*) > {K.MIN_SKILL_POSTINGS} ORDER BY avg_salary DESC, skill LIMIT {K.TOP_SKILLS}"""))
def q_competitive_skills(spark, sf):
    """K-04."""
    return K.competitive_skills(_b(spark, sf))


def _percentile_sql(requests: str) -> str:
    """Every request against all postings of its slice; an unset value sets no condition."""
    return _sql(f"req AS ({requests})", body="""
SELECT *, CASE WHEN percentile >= 70 THEN 'above' WHEN percentile >= 40 THEN 'middle'
               WHEN percentile IS NOT NULL THEN 'below' END AS position
FROM (
    SELECT r.sector, r.experience_level, r.salary,
        COUNT(s.job_id) FILTER (WHERE s.market_salary <= r.salary) AS lower_count,
        COUNT(s.job_id) AS comparable_postings,
        100.0 * COUNT(s.job_id) FILTER (WHERE s.market_salary <= r.salary) / NULLIF(COUNT(s.job_id), 0) AS percentile
    FROM req r LEFT JOIN (SELECT coalesce(job_id, '') AS job_id, sector, experience_level, market_salary FROM sb) s
      ON (r.sector IS NULL OR s.sector = r.sector) AND (r.experience_level IS NULL OR s.experience_level = r.experience_level)
    GROUP BY r.sector, r.experience_level, r.salary)""")


@register("salary_percentile", _percentile_sql("SELECT DISTINCT sector, experience_level, market_salary AS salary FROM sb"))
def q_salary_percentile(spark, sf):
    """K-05 for every (sector, experience level, salary) present (unrounded percentile)."""
    b = _b(spark, sf)
    req = b.select("sector", "experience_level", F.col("market_salary").alias("salary"))
    return K.salary_percentile(b, req, decimals=None)


@register("salary_percentile_unset", _percentile_sql("""SELECT DISTINCT CAST(NULL AS VARCHAR) AS sector, experience_level, round(market_salary, -2) AS salary FROM sb
    UNION SELECT sector, NULL, round(market_salary, -2) FROM sb UNION SELECT NULL, NULL, round(market_salary, -2) FROM sb
    UNION SELECT 'No such sector', NULL, 5000.0"""))
def q_salary_percentile_unset(spark, sf):
    """K-05 with one or both filters unset, and a sector without postings."""
    b = _b(spark, sf)
    salary = F.round("market_salary", -2).alias("salary")
    none = F.lit(None).cast("string")
    req = (b.select(none.alias("sector"), "experience_level", salary).union(b.select("sector", none, salary))
           .union(b.select(none, none, salary)).distinct()
           .union(spark.range(1).select(F.lit("No such sector"), none, F.lit(5000.0))))
    return K.salary_percentile(b, req, decimals=None)


@register("pay_by_years", _sql(body="SELECT seniority_years, round_even(MEDIAN(market_salary), 0) AS median_salary FROM sb "
                                    "WHERE seniority_years IS NOT NULL GROUP BY seniority_years"))
def q_pay_by_years(spark, sf):
    """K-06."""
    return K.pay_by_years(_b(spark, sf))


@register("seniority_ladder", _sql(body="SELECT coalesce(position_level, 'Unspecified') AS position_level, "
                                        "round_even(MEDIAN(market_salary), 0) AS median_salary FROM sb GROUP BY 1"))
def q_seniority_ladder(spark, sf):
    """K-07."""
    return K.seniority_ladder(_b(spark, sf))


@register("pay_range_width", _sql(body="""SELECT sector, experience_level,
    round_even(quantile_cont(market_salary, 0.9) - quantile_cont(market_salary, 0.1), 0) AS pay_range
    FROM sb WHERE sector IS NOT NULL AND experience_level IS NOT NULL GROUP BY sector, experience_level
    ORDER BY pay_range DESC, sector, experience_level LIMIT 10"""))
def q_pay_range_width(spark, sf):
    """K-08."""
    return K.pay_range_width(_b(spark, sf))


@register("competition_high_low", _sql("""ct AS (
    SELECT title, COUNT(*) AS postings, SUM(vacancies) AS vacancies, MEDIAN(market_salary) AS median_salary,
           COUNT(*) * 1.0 / NULLIF(SUM(vacancies), 0) AS competition_ratio FROM sb WHERE title IS NOT NULL GROUP BY title)""",
    """cl AS (
    SELECT job_label, CAST(SUM(postings) AS BIGINT) AS postings, AVG(competition_ratio) AS competition_ratio,
           AVG(median_salary) AS median_salary FROM ct LEFT JOIN tl USING (title) GROUP BY job_label)""",
    body="""SELECT * FROM (SELECT *, 'High' AS competition_type FROM cl
        ORDER BY competition_ratio DESC NULLS LAST, postings DESC, job_label NULLS LAST LIMIT 5)
    UNION ALL
    SELECT * FROM (SELECT *, 'Low' AS competition_type FROM cl
        ORDER BY competition_ratio ASC NULLS LAST, postings DESC, job_label NULLS LAST LIMIT 5)"""))
def q_competition(spark, sf):
    """K-09."""
    return K.competition_high_low(_b(spark, sf))


# ---- sliced variants (the candidate picks a sector and experience level) -----------

_KS, _KE = "Engineering", "Senior"


@register("seeker_headline_slice", _sql(body=f"""SELECT COUNT(*) AS total_opportunities, COUNT(DISTINCT sector) AS sectors_hiring,
    round_even(MEDIAN(market_salary), 0) AS median_salary, MAX(salary_max) AS top_salary FROM sb
    WHERE sector = '{_KS}' AND experience_level = '{_KE}'"""))
def q_seeker_headline_slice(spark, sf):
    """K-01 on one sector x experience slice (F-03 filters)."""
    return K.headline(K.seeker_base(Postings(spark, sf).jobs(), sector=_KS, experience_level=_KE))


@register("pay_by_years_slice", _sql(body=f"""SELECT seniority_years, round_even(MEDIAN(market_salary), 0) AS median_salary FROM sb
    WHERE sector = '{_KS}' AND seniority_years IS NOT NULL GROUP BY seniority_years"""))
def q_pay_by_years_slice(spark, sf):
    """K-06 on one sector."""
    return K.pay_by_years(K.seeker_base(Postings(spark, sf).jobs(), sector=_KS))
