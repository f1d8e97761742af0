"""Registered notebook statistics (N-01..N-13) with their oracles."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import benchmark as H
from ..operators import stats as N
from . import params as P
from .oracle_base import BIND, CLEAN, JOBS, with_ctes
from .postings import Postings
from .q_hirer import HM
from .registry import register


def _m(spark, sf):
    return H.hirer_market(Postings(spark, sf).deduped(), cutoff=P.CUTOFF)


def _sql(*extra: str, body: str) -> str:
    return with_ctes(BIND, CLEAN, JOBS, HM, *extra, body=body)


@register("counter_regime", with_ctes(BIND, CLEAN, JOBS, body="""SELECT m.*, (SELECT AVG(CAST(coalesce(expiry_date < (SELECT MAX(posting_date) FROM jobs), false) AS DOUBLE))
    FROM jobs WHERE status_jobStatus = 'Open') AS stale_open_share
FROM (SELECT strftime(posting_date, '%Y-%m') AS month, COUNT(*) AS n, MEDIAN(views) AS median_views, MEDIAN(applications) AS median_apps
      FROM jobs WHERE posting_date IS NOT NULL GROUP BY 1) m"""))
def q_counter_regime(spark, sf):
    """N-01 on the (not deduplicated) fact."""
    return N.counter_regime(Postings(spark, sf).jobs())


@register("market_shape", _sql(body="""SELECT CASE WHEN GROUPING(position_level) = 1 THEN 'All levels' ELSE position_level END AS position_level,
    COUNT(*) AS postings, MEDIAN(seniority_years) AS median_years, MEDIAN(salary_midpoint) AS median_salary_midpoint,
    CASE WHEN GROUPING(position_level) = 1 THEN 100.0
         ELSE COUNT(*) * 100.0 / (SELECT COUNT(position_level) FROM hm) END AS share_pct
FROM hm GROUP BY GROUPING SETS ((position_level), ()) HAVING GROUPING(position_level) = 1 OR position_level IS NOT NULL"""))
def q_market_shape(spark, sf):
    """N-02."""
    return N.market_shape(_m(spark, sf))


_DENSITY = f"""dn_ev AS (
    SELECT sector, position_level, day, SUM(d) AS delta FROM (
        SELECT sector, position_level, posting_date AS day, 1 AS d FROM hm
        WHERE posting_date IS NOT NULL AND sector IS NOT NULL AND position_level IS NOT NULL
        UNION ALL
        SELECT sector, position_level, expiry_date, -1 FROM hm
        WHERE expiry_date IS NOT NULL AND sector IS NOT NULL AND position_level IS NOT NULL) GROUP BY 1, 2, 3),
dn_b AS (SELECT MIN(posting_date) AS cs, MAX(expiry_date) AS ce, MAX(posting_date) AS we FROM hm),
dn_g AS (SELECT DISTINCT sector, position_level FROM hm WHERE sector IS NOT NULL AND position_level IS NOT NULL
         AND (posting_date IS NOT NULL OR expiry_date IS NOT NULL)),
dn_grid AS (SELECT g.sector, g.position_level, CAST(unnest(generate_series(b.cs, b.ce, INTERVAL 1 DAY)) AS DATE) AS day, b.cs, b.we
            FROM dn_g g, dn_b b),
dn_live AS (
    SELECT grid.sector, grid.position_level, grid.day, grid.cs, grid.we,
           CAST(SUM(coalesce(ev.delta, 0)) OVER (PARTITION BY grid.sector, grid.position_level ORDER BY grid.day
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS live
    FROM dn_grid grid LEFT JOIN dn_ev ev ON ev.sector = grid.sector AND ev.position_level = grid.position_level AND ev.day = grid.day),
dn_valid AS (SELECT * FROM dn_live WHERE day >= cs + {N.WARMUP_DAYS} AND day <= we)"""


@register("competition_density", _sql(_DENSITY, body="SELECT sector, position_level, MEDIAN(live) AS median_live_comparables FROM dn_valid GROUP BY 1, 2"))
def q_density(spark, sf):
    """N-03: median live comparable postings per sector x level."""
    return N.competition_density(_m(spark, sf))


@register("live_postings_total", _sql(_DENSITY, body="SELECT day, CAST(SUM(live) AS BIGINT) AS total_live FROM dn_valid GROUP BY day"))
def q_live_total(spark, sf):
    """N-03: the market's daily live postings over the valid window."""
    return N.live_postings_total(_m(spark, sf))


@register("exposure_effect", _sql(body=f"""SELECT listing_days, COUNT(*) AS n, MEDIAN(views) AS median_views, MEDIAN(applications) AS median_apps
    FROM hm WHERE counters_complete GROUP BY listing_days HAVING COUNT(*) >= {N.MIN_EFFECT_N}"""))
def q_exposure_effect(spark, sf):
    """N-05."""
    return N.exposure_effect(_m(spark, sf))


@register("cycle_effect", _sql(body=f"""SELECT repost_count, COUNT(*) AS n, MEDIAN(views) AS median_views, MEDIAN(applications) AS median_apps
    FROM l2 GROUP BY repost_count"""))
def q_cycle_effect(spark, sf):
    """N-05."""
    return N.cycle_effect(_m(spark, sf))


def _censor_case() -> str:
    parts = [f"WHEN dd > {N.CENSOR_BINS[i]} AND dd <= {N.CENSOR_BINS[i + 1]} THEN '{lbl}'" for i, lbl in enumerate(N.CENSOR_LABELS)]
    return "CASE " + " ".join(parts) + " END"


@register("censoring_check", _sql(body=f"""SELECT bucket, COUNT(*) AS n, AVG(CAST(is_repost AS DOUBLE)) AS repost_rate FROM (
    SELECT *, {_censor_case()} AS bucket FROM (SELECT *, date_diff('day', expiry_date, DATE '{P.CUTOFF}') AS dd FROM l2))
    WHERE bucket IS NOT NULL GROUP BY bucket"""))
def q_censoring(spark, sf):
    """N-06."""
    return N.censoring_check(_m(spark, sf), P.CUTOFF)


def _resp_sql(keys) -> str:
    k = ", ".join(keys)
    nn = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    return f"""SELECT {k}, COUNT(*) AS n, quantile_cont(applications, 0.1) AS apps_p10, quantile_cont(applications, 0.5) AS apps_p50,
    quantile_cont(applications, 0.9) AS apps_p90, AVG(CAST(applications = 0 AS DOUBLE)) AS zero_rate,
    AVG(CAST(applications < vacancies AS DOUBLE)) AS under_filled, MEDIAN(views) AS views_p50
    FROM fc WHERE {nn} GROUP BY {k} HAVING COUNT(*) >= {H.MIN_N}"""


@register("response_benchmark", _sql(body=_resp_sql(N.RESPONSE_KEYS_3)))
def q_response_benchmark(spark, sf):
    """N-07 at sector x level x band."""
    return N.response_benchmark(_m(spark, sf), N.RESPONSE_KEYS_3)


@register("response_benchmark_2key", _sql(body=_resp_sql(N.RESPONSE_KEYS_2)))
def q_response_benchmark_2(spark, sf):
    """N-07 at sector x level."""
    return N.response_benchmark(_m(spark, sf), N.RESPONSE_KEYS_2)


_RID = "concat_ws('|', coalesce(sector, '*'), coalesce(position_level, '*'), coalesce(pay_band, '*'))"


@register("response_lookup", _sql(f"rl_req AS (SELECT DISTINCT *, {_RID} AS request_id FROM (SELECT sector, position_level, pay_band FROM hm "
                                  "UNION ALL SELECT sector, position_level, NULL FROM hm))",
                                  f"r3 AS ({_resp_sql(N.RESPONSE_KEYS_3)})", f"r2 AS ({_resp_sql(N.RESPONSE_KEYS_2)})",
                                  """rg AS (SELECT COUNT(*) AS n, quantile_cont(applications, 0.1) AS apps_p10, quantile_cont(applications, 0.5) AS apps_p50,
    quantile_cont(applications, 0.9) AS apps_p90, AVG(CAST(applications = 0 AS DOUBLE)) AS zero_rate,
    AVG(CAST(applications < vacancies AS DOUBLE)) AS under_filled FROM fc)""",
                                  body="""SELECT q.request_id, q.sector, q.position_level, q.pay_band,
    CASE WHEN r3.n IS NOT NULL THEN 'sector + level + band' WHEN r2.n IS NOT NULL THEN 'sector + level' ELSE 'all postings (no comparable cell)' END AS grain,
    coalesce(r3.n, r2.n, rg.n) AS n, coalesce(r3.apps_p10, r2.apps_p10, rg.apps_p10) AS apps_p10,
    coalesce(r3.apps_p50, r2.apps_p50, rg.apps_p50) AS apps_p50, coalesce(r3.apps_p90, r2.apps_p90, rg.apps_p90) AS apps_p90,
    coalesce(r3.zero_rate, r2.zero_rate, rg.zero_rate) AS zero_rate, coalesce(r3.under_filled, r2.under_filled, rg.under_filled) AS under_filled
FROM rl_req q LEFT JOIN r3 ON r3.sector = q.sector AND r3.position_level = q.position_level AND r3.pay_band = q.pay_band
LEFT JOIN r2 ON r2.sector = q.sector AND r2.position_level = q.position_level, rg"""))
def q_response_lookup(spark, sf):
    """N-07 two-rung lookup for every (sector, level, band) present, with and without the band."""
    m = _m(spark, sf)
    req = (m.select("sector", "position_level", "pay_band")
           .unionByName(m.select("sector", "position_level", F.lit(None).cast("string").alias("pay_band"))).distinct()
           .withColumn("request_id", F.expr(_RID)))
    return N.response_lookup(m, req)


def _spearman_sql() -> str:
    cols = N.SPEARMAN_COLUMNS
    nullable = ("experience_level_rank",)
    exp_case = "CASE experience_level " + " ".join(f"WHEN '{x}' THEN {i}.0" for i, x in enumerate(H.EXP_ORDER)) + " END"
    si = f"""st AS (SELECT * FROM hm WHERE counters_complete),
sp_lvl AS (SELECT position_level, CAST(row_number() OVER (ORDER BY MEDIAN(seniority_years), position_level) - 1 AS DOUBLE) AS position_level_rank
           FROM st WHERE position_level IS NOT NULL GROUP BY position_level),
sp_comp AS (SELECT company, CAST(COUNT(*) AS DOUBLE) AS company_postings FROM st GROUP BY company),
si AS (SELECT st.job_id, CAST(applications AS DOUBLE) AS applications, CAST(views AS DOUBLE) AS views,
        CAST(repost_count AS DOUBLE) AS repost_count, CAST(is_repost AS DOUBLE) AS is_repost,
        CAST(vacancies AS DOUBLE) AS vacancies, CAST(listing_days AS DOUBLE) AS listing_days,
        l.position_level_rank, {exp_case} AS experience_level_rank,
        CASE WHEN job_type IN ('Permanent', 'Full Time') THEN 1.0 ELSE 0.0 END AS job_type_permanent,
        CASE WHEN st.company IS NOT NULL THEN c.company_postings END AS company_postings,
        CAST(metadata_isPostedOnBehalf AS DOUBLE) AS posted_on_behalf
    FROM st LEFT JOIN sp_lvl l USING (position_level) LEFT JOIN sp_comp c ON c.company IS NOT DISTINCT FROM st.company)"""

    def rk(c, cond):
        return (f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} NULLS LAST) + "
                f"(COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS r_{c}")
    ranks_all = "rk_all AS (SELECT job_id, " + ", ".join(rk(c, None) for c in cols) + " FROM si)"
    ranks_e = ("rk_e AS (SELECT job_id, " + ", ".join(rk(c, None) for c in cols) +
               " FROM si WHERE experience_level_rank IS NOT NULL)")
    parts = []
    for i, x in enumerate(cols):
        for y in cols[i + 1:]:
            t = "rk_e" if ({x, y} & set(nullable)) else "rk_all"
            both = f"r_{x} IS NOT NULL AND r_{y} IS NOT NULL"
            xv, yv = f"CASE WHEN {both} THEN r_{x} END", f"CASE WHEN {both} THEN r_{y} END"
            parts.append(f"SELECT '{x}' AS column_a, '{y}' AS column_b, covar_samp({xv}, {yv}) / "
                         f"NULLIF(stddev_samp({xv}) * stddev_samp({yv}), 0) AS spearman_rho FROM {t}")
    return _sql(si, ranks_all, ranks_e, body=" UNION ALL ".join(parts))


@register("spearman_matrix", _spearman_sql())
def q_spearman(spark, sf):
    """N-08: 55 pairwise Spearman correlations over counters-complete postings."""
    return N.spearman_matrix(_m(spark, sf))


def _sql_erfc(x: str) -> str:
    """Maclaurin series below 2, continued fraction above."""
    z = f"abs({x})"
    series = (f"1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), "
              f"lambda n: pow(-1.0, n) * pow({z}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))")
    fraction = (f"exp(-({z}) * ({z})) / sqrt(pi()) / ({z} + list_reduce([0.0::DOUBLE] || list_transform(range(80, 0, -1), lambda k: k::DOUBLE), "
                f"lambda f, k: (k / 2) / ({z} + f)))")
    below = f"(CASE WHEN {z} < 2 THEN {series} ELSE {fraction} END)"
    return f"(CASE WHEN {x} >= 0 THEN {below} ELSE 2.0 - {below} END)"


def _sql_chi2_sf(x: str, k: str) -> str:
    y = f"(({x}) / 2.0)"
    even = (f"exp(-{y}) * coalesce(list_sum(list_transform(range(0, CAST(floor(({k}) / 2) AS BIGINT)), "
            f"lambda j: exp(j * ln({y}) - lgamma(j + 1)))), 0)")
    odd = (f"{_sql_erfc(f'sqrt({y})')} + exp(-{y}) * coalesce(list_sum(list_transform(range(0, CAST(floor(({k}) / 2) AS BIGINT)), "
           f"lambda j: exp((j + 0.5) * ln({y}) - lgamma(j + 1.5)))), 0)")
    return f"(CASE WHEN {x} IS NULL OR {k} IS NULL OR {k} < 1 THEN NULL WHEN {x} <= 0 THEN 1.0 WHEN {k} % 2 = 0 THEN {even} ELSE {odd} END)"


_STRATA = f"""sa AS (
    SELECT pay_band,
        CAST(COUNT(*) FILTER (WHERE hi AND is_repost) AS DOUBLE) AS a, CAST(COUNT(*) FILTER (WHERE hi AND NOT is_repost) AS DOUBLE) AS b,
        CAST(COUNT(*) FILTER (WHERE NOT hi AND is_repost) AS DOUBLE) AS c, CAST(COUNT(*) FILTER (WHERE NOT hi AND NOT is_repost) AS DOUBLE) AS d
    FROM (SELECT *, least(greatest(seniority_years, 0), 15) >= {N.HIGH_EXPERIENCE_YEARS} AS hi FROM l2 WHERE pay_band IS NOT NULL)
    GROUP BY pay_band),
sn AS (SELECT *, a + b + c + d AS n FROM sa)"""


@register("mantel_haenszel", _sql(_STRATA, """mh AS (SELECT SUM(a) AS A, SUM(b) AS B, SUM(c) AS Cc, SUM(d) AS D, SUM(a * d / n) AS r, SUM(b * c / n) AS s,
    SUM((a + b) * (a + c) / n) AS E, SUM((a + b) * (c + d) * (a + c) * (b + d) / nullif(n * n * (n - 1), 0)) AS V, COUNT(*) AS strata, SUM(n) AS n FROM sn)""",
    body=f"""SELECT CAST(n AS BIGINT) AS n, strata, A * D / NULLIF(B * Cc, 0) AS crude_odds_ratio, r / NULLIF(s, 0) AS mh_odds_ratio,
    (A - E) * (A - E) / NULLIF(V, 0) AS null_test_chi2,
    {_sql_chi2_sf('((A - E) * (A - E) / NULLIF(V, 0))', '1')} AS null_test_p FROM mh"""))
def q_mh(spark, sf):
    """N-09: crude vs Mantel-Haenszel odds ratio of reposting for >= 3 years asked, strata = pay band."""
    return N.mantel_haenszel(_m(spark, sf))


@register("stratum_odds_ratio", _sql(_STRATA, body=f"""SELECT pay_band, CAST(n AS BIGINT) AS n, c / NULLIF(c + d, 0) * 100 AS repost_pct_lt3,
    a / NULLIF(a + b, 0) * 100 AS repost_pct_gte3, a / NULLIF(a + b, 0) * 100 - c / NULLIF(c + d, 0) * 100 AS diff_pp,
    exp(l) AS odds_ratio, exp(l - 1.959963984540054 * e) AS ci_low, exp(l + 1.959963984540054 * e) AS ci_high,
    {_sql_erfc("(abs(l / e) / sqrt(2.0))")} AS p_value
FROM (SELECT *, ln(oa) + ln(od) - ln(ob) - ln(oc) AS l, sqrt(1 / oa + 1 / ob + 1 / oc + 1 / od) AS e
      FROM (SELECT *, if(a = 0, 0.5, a) AS oa, if(b = 0, 0.5, b) AS ob, if(c = 0, 0.5, c) AS oc, if(d = 0, 0.5, d) AS od FROM sn))"""))
def q_stratum_or(spark, sf):
    """N-10: per-band odds ratio with 95 % Wald interval and p-value."""
    return N.stratum_odds_ratio(_m(spark, sf))


@register("breslow_day", _sql(_STRATA, """bd_psi AS (SELECT SUM(a * d / n) / NULLIF(SUM(b * c / n), 0) AS psi, COUNT(*) AS k FROM sn)""",
    """bd_q AS (SELECT *, 1 - psi AS qa, n - (a + b) - (a + c) + psi * ((a + b) + (a + c)) AS qb, -psi * (a + b) * (a + c) AS qc,
        greatest(0.0, (a + b) + (a + c) - n) AS lo, least(a + b, a + c) AS hi FROM sn, bd_psi)""",
    """bd_r AS (SELECT *, (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS root1, (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS root2 FROM bd_q)""",
    """bd_a AS (SELECT *, CASE WHEN abs(qa) < 1e-12 THEN (a + b) * (a + c) / n
        WHEN root1 >= lo - 1e-9 AND root1 <= hi + 1e-9 THEN root1 ELSE root2 END AS aa FROM bd_r)""",
    """bd_t AS (SELECT k, (a - aa) * (a - aa) / (1 / (1 / nullif(aa, 0) + 1 / nullif((a + b) - aa, 0) + 1 / nullif((a + c) - aa, 0) + 1 / nullif(n - (a + b) - (a + c) + aa, 0))) AS term FROM bd_a)""",
    body=f"SELECT k - 1 AS df, chi2, {_sql_chi2_sf('chi2', '(k - 1)')} AS p_value FROM (SELECT k, SUM(coalesce(term, 0)) AS chi2 FROM bd_t GROUP BY k)"))
def q_breslow_day(spark, sf):
    """N-10: Breslow-Day homogeneity of the per-band odds ratios."""
    return N.breslow_day(_m(spark, sf))


@register("pay_band_spread", _sql(body="""SELECT pay_band, COUNT(*) AS n, round_even(MEDIAN(salary_min), 0) AS min_p50,
    round_even(MEDIAN(salary_midpoint), 0) AS mid_p50, round_even(MEDIAN(salary_max), 0) AS max_p50 FROM l2 GROUP BY pay_band"""))
def q_pay_band_spread(spark, sf):
    """N-11 (the null band row counts the unassigned postings)."""
    return N.pay_band_spread(_m(spark, sf))


@register("applications_profile", _sql(body=f"""SELECT COUNT(applications) AS count, AVG(applications) AS mean, STDDEV_SAMP(applications) AS std,
    MIN(applications) AS min, {", ".join(f"quantile_cont(applications, {q}) AS p{int(round(q * 100))}" for q in N.PROFILE_QUANTILES)},
    MAX(applications) AS max, AVG(CAST(applications = 0 AS DOUBLE)) AS zero_rate,
    AVG(CAST(applications < vacancies AS DOUBLE)) AS under_filled_rate FROM fc"""))
def q_app_profile(spark, sf):
    """N-12."""
    return N.applications_profile(_m(spark, sf))


@register("repost_overall", _sql(body="SELECT yrs_bucket, COUNT(*) AS n, AVG(CAST(is_repost AS DOUBLE)) AS repost_rate FROM l2 "
                                      "WHERE yrs_bucket IS NOT NULL GROUP BY yrs_bucket"))
def q_repost_overall(spark, sf):
    """N-13."""
    return N.repost_overall(_m(spark, sf))
