"""Registered hirer queries (H-01..H-13, N-04) with their oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark as H
from ..session import stored
from . import params as P
from .oracle_base import BIND, CLEAN, JOBS, with_ctes
from .postings import Postings
from .registry import register


def _bins_sql(col: str, edges, labels) -> str:
    parts = [f"WHEN {col} > {edges[i]!r} AND {col} <= {edges[i + 1]!r} THEN '{lbl}'" for i, lbl in enumerate(labels)]
    return "CASE " + " ".join(parts) + " END"


HM = f"""hm AS (
    SELECT *, coalesce(expiry_date <= DATE '{P.CUTOFF}', false) AS counters_complete,
        {_bins_sql("seniority_years", H.YR_BINS, H.YR_LABELS)} AS yrs_bucket,
        {_bins_sql("salary_midpoint", H.PAY_BINS, H.PAY_LABELS)} AS pay_band
    FROM deduped),
l2 AS (SELECT * FROM hm WHERE counters_complete AND coalesce(listing_days = 30, false)),
fc AS (SELECT * FROM l2 WHERE repost_count = 0 AND pay_band IS NOT NULL)"""


def _sql(*extra: str, body: str) -> str:
    return with_ctes(BIND, CLEAN, JOBS, HM, *extra, body=body)


def _m(spark, sf):
    return H.hirer_market(Postings(spark, sf).deduped(), cutoff=P.CUTOFF)


@register("hirer_market", _sql(body="SELECT job_id, counters_complete, yrs_bucket, pay_band FROM hm"))
def q_hirer_market(spark, sf):
    """H-01."""
    return _m(spark, sf).select("job_id", "counters_complete", "yrs_bucket", "pay_band")


@register("yrs_pay_buckets", _sql(body="SELECT yrs_bucket, pay_band, COUNT(*) AS n FROM hm GROUP BY yrs_bucket, pay_band"))
def q_yrs_pay_buckets(spark, sf):
    """H-02: postings per (year bucket, pay band)."""
    return _m(spark, sf).groupBy("yrs_bucket", "pay_band").agg(F.count(F.lit(1)).alias("n"))


@register("layer2_cohort", _sql(body="SELECT job_id, sector, pay_band, is_repost FROM l2"))
def q_layer2(spark, sf):
    """H-03."""
    return H.layer2_cohort(_m(spark, sf)).select("job_id", "sector", "pay_band", "is_repost")


@register("levels_by_seniority", _sql(body="""SELECT position_level, median_years,
    CAST(row_number() OVER (ORDER BY median_years, position_level) AS INTEGER) AS level_rank
    FROM (SELECT position_level, MEDIAN(seniority_years) AS median_years FROM hm
          WHERE position_level IS NOT NULL GROUP BY position_level)"""))
def q_levels(spark, sf):
    """H-04."""
    return H.levels_by_seniority(_m(spark, sf))


def _bench_sql(keys, extended: bool = False, min_n: int = H.MIN_N) -> str:
    k = ", ".join(keys)
    notnull = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    ext = (", round_even(MEDIAN(salary_min), 0) AS min_p50, round_even(MEDIAN(salary_max), 0) AS max_p50,"
           " round_even(MEDIAN(seniority_years), 0) AS yrs_p50") if extended else ""
    return f"""SELECT {k}, COUNT(*) AS n,
        round_even(quantile_cont(salary_midpoint, 0.25), 0) AS mid_p25,
        round_even(quantile_cont(salary_midpoint, 0.5), 0) AS mid_p50,
        round_even(quantile_cont(salary_midpoint, 0.75), 0) AS mid_p75{ext}
    FROM hm WHERE salary_flag = 'ok' AND {notnull} GROUP BY {k} HAVING COUNT(*) >= {min_n}"""


for _name, _keys in [("salary_benchmark_4key", H.KEYS_4), ("salary_benchmark_3key", H.KEYS_3),
                     ("salary_benchmark_2key", H.KEYS_2)]:
    def _mk(keys):
        def q(spark, sf):
            """H-05: benchmark cells with small-cell suppression."""
            return H.salary_benchmark(_m(spark, sf), keys)
        return q
    register(_name, _sql(body=_bench_sql(_keys)))(_mk(_keys))


@register("benchmark_coverage", _sql(f"bc AS ({_bench_sql(H.KEYS_3, extended=True)})",
                                     body="SELECT bc.*, n * 100.0 / (SELECT COUNT(*) FROM hm WHERE salary_flag = 'ok') AS coverage_pct FROM bc"))
def q_benchmark_coverage(spark, sf):
    """N-04: 3-key extended benchmark with coverage."""
    return H.benchmark_coverage(_m(spark, sf), H.KEYS_3)


# ---- H-06 ladder: requests derived from the market's own configurations ------

_RID = "concat_ws('|', coalesce(sector, '*'), coalesce(position_level, '*'), coalesce(experience_level, '*'), coalesce(yrs_bucket, '*'))"


def _requests(m):
    d = H.DIMS
    null = F.lit(None).cast("string")
    m = m.select(*d).distinct()  # the market's configurations, read once
    full = m
    two = m.select("sector", "position_level", null.alias("experience_level"), null.alias("yrs_bucket"))
    ly = m.select(null.alias("sector"), "position_level", null.alias("experience_level"), "yrs_bucket")
    ex = m.select(null.alias("sector"), null.alias("position_level"), "experience_level", null.alias("yrs_bucket"))
    none = m.select(*[null.alias(x) for x in d]).distinct()   # the one unnarrowed request
    req = full.unionByName(two).unionByName(ly).unionByName(ex).unionByName(none).distinct()
    return req.withColumn("request_id", F.expr(_RID))


_REQS = f"""req AS (
    SELECT DISTINCT *, {_RID} AS request_id FROM (
        SELECT {', '.join(H.DIMS)} FROM hm
        UNION ALL SELECT sector, position_level, NULL, NULL FROM hm
        UNION ALL SELECT NULL, position_level, NULL, yrs_bucket FROM hm
        UNION ALL SELECT NULL, NULL, experience_level, NULL FROM hm
        UNION ALL SELECT NULL, NULL, NULL, NULL))"""
_POSTING_REQS = f"""req AS (
    SELECT job_id AS request_id, {', '.join(H.DIMS)}, salary_midpoint AS salary FROM hm WHERE salary_flag = 'ok')"""
_FLAG_BODY = """SELECT request_id, grain, salary, mid_p25, mid_p75,
    CASE WHEN salary < mid_p25 THEN 'below_p25' WHEN salary > mid_p75 THEN 'above_p75' ELSE 'within' END AS salary_position
FROM (SELECT lk.*, q.salary FROM lk JOIN req q USING (request_id))"""


def _ladder_sql(reqs: str = _REQS, outer: str | None = None) -> str:
    d = H.DIMS
    cells = []
    subsets = H._subsets()
    for s in subsets:
        m = H._mask(s)
        cells.append(f"cell_{m} AS ({_bench_sql(s)})")
    cands = []
    for spec_mask in range(1, 16):
        dims = [x for i, x in enumerate(d) if spec_mask & (1 << i)]
        spec_cond = " AND ".join([f"r.{x} IS NOT NULL" for x in dims] + [f"r.{x} IS NULL" for x in d if x not in dims])
        for j, rung in enumerate(H.ladder(dims)):
            m = H._mask(rung)
            on = " AND ".join(f"c.{x} = r.{x}" for x in rung)
            grain = " + ".join(H.GRAIN_NAMES[k] for k in rung)
            cands.append(f"SELECT r.request_id, {j} AS rung_no, '{grain}' AS grain, c.n, c.mid_p25, c.mid_p50, c.mid_p75 "
                         f"FROM req r JOIN cell_{m} c ON {on} WHERE {spec_cond}")
    cand = "cand AS (" + "\nUNION ALL ".join(cands) + ")"
    best = "best AS (SELECT request_id, arg_min(grain, rung_no) AS grain, arg_min(n, rung_no) AS n, arg_min(mid_p25, rung_no) AS mid_p25, " \
           "arg_min(mid_p50, rung_no) AS mid_p50, arg_min(mid_p75, rung_no) AS mid_p75 FROM cand GROUP BY request_id)"
    glob = ("g_all AS (SELECT COUNT(*) AS g_n, quantile_cont(salary_midpoint, 0.25) AS g25, quantile_cont(salary_midpoint, 0.5) AS g50, "
            "quantile_cont(salary_midpoint, 0.75) AS g75 FROM hm WHERE salary_flag = 'ok')")
    body = f"""SELECT r.request_id, {', '.join('r.' + x for x in d)},
    coalesce(b.grain, CASE WHEN {' AND '.join(f'r.{x} IS NULL' for x in d)} THEN 'all postings' ELSE 'all postings (no comparable cell)' END) AS grain,
    coalesce(b.n, g_n) AS n,
    CASE WHEN b.grain IS NOT NULL THEN b.mid_p25 ELSE g25 END AS mid_p25,
    CASE WHEN b.grain IS NOT NULL THEN b.mid_p50 ELSE g50 END AS mid_p50,
    CASE WHEN b.grain IS NOT NULL THEN b.mid_p75 ELSE g75 END AS mid_p75
FROM req r LEFT JOIN best b ON b.request_id = r.request_id, g_all"""
    if outer is not None:
        return _sql(reqs, *cells, cand, best, glob, f"lk AS ({body})", body=outer)
    return _sql(reqs, *cells, cand, best, glob, body=body)


@register("salary_lookup_ladder", _ladder_sql())
def q_salary_lookup(spark, sf):
    """H-06 for every configuration present in the market, plus partial ones."""
    m = _m(spark, sf)
    return H.salary_lookup(m, _requests(m))


@register("salary_position_flag", _ladder_sql(_POSTING_REQS, _FLAG_BODY))
def q_salary_position_flag(spark, sf):
    """H-13: every ok posting's own midpoint against its 4-dim ladder benchmark."""
    m = _m(spark, sf)
    ok = m.where(F.col("salary_flag") == "ok")
    req = ok.select(F.col("job_id").alias("request_id"), *H.DIMS, F.col("salary_midpoint").alias("salary"))
    looked_up = H.salary_lookup(m, req, store=lambda best: stored(best, "benchmarks"))
    return H.salary_position_flag(looked_up).select("request_id", "grain", "salary", "mid_p25", "mid_p75", "salary_position")


_NORMS = f"""cell AS (
    SELECT position_level, yrs_bucket, COUNT(*) AS n FROM hm
    WHERE position_level IS NOT NULL AND yrs_bucket IS NOT NULL GROUP BY position_level, yrs_bucket),
lv AS (SELECT position_level, CAST(row_number() OVER (ORDER BY MEDIAN(seniority_years), position_level) AS INTEGER) AS level_rank
       FROM hm WHERE position_level IS NOT NULL GROUP BY position_level),
norms AS (
    SELECT c.position_level, c.yrs_bucket, c.n, t.level_n, c.n * 100.0 / t.level_n AS share_pct, lv.level_rank,
           c.n * 100.0 / t.level_n < {H.RARE_SHARE_PCT} AS rare
    FROM cell c JOIN (SELECT position_level, SUM(n) AS level_n FROM cell GROUP BY position_level) t USING (position_level)
    LEFT JOIN lv USING (position_level)
    WHERE t.level_n >= {H.MIN_N})"""


@register("config_norms", _sql(_NORMS, body="SELECT position_level, yrs_bucket, n, CAST(level_n AS BIGINT) AS level_n, share_pct, level_rank, rare FROM norms"))
def q_config_norms(spark, sf):
    """H-07 in long form."""
    return H.config_norms(_m(spark, sf))


@register("rare_configs", _sql(_NORMS, body="SELECT position_level, yrs_bucket, share_pct FROM norms WHERE rare"))
def q_rare_configs(spark, sf):
    """H-07: level x years pairs used by under 1 % of the level's postings."""
    return H.config_norms(_m(spark, sf)).where("rare").select("position_level", "yrs_bucket", "share_pct")


@register("response_by_pay_band", _sql(body=f"""SELECT pay_band, COUNT(*) AS n,
    quantile_cont(applications, 0.1) AS apps_p10, quantile_cont(applications, 0.5) AS apps_p50,
    quantile_cont(applications, 0.9) AS apps_p90, AVG(CAST(applications < vacancies AS DOUBLE)) AS under_filled
    FROM fc GROUP BY pay_band HAVING COUNT(*) >= {H.MIN_N}"""))
def q_response(spark, sf):
    """H-08."""
    return H.response_by_pay_band(_m(spark, sf))


@register("funnel_by_pay_band", _sql(body=f"""SELECT pay_band, COUNT(*) AS n, MEDIAN(views) AS views_p50,
    MEDIAN(applications * 1.0 / NULLIF(views, 0)) AS conversion_p50,
    MEDIAN(applications * 1.0 / NULLIF(views, 0)) * 100 AS conversion_pct
    FROM fc GROUP BY pay_band HAVING COUNT(*) >= {H.MIN_N}"""))
def q_funnel(spark, sf):
    """H-09."""
    return H.funnel_by_pay_band(_m(spark, sf))


def _matrix_sql(min_n: int) -> str:
    bands = " UNION ALL ".join(f"SELECT '{b}' AS pay_band" for b in H.PAY_LABELS)
    yrs = " UNION ALL ".join(f"SELECT '{y}' AS yrs_bucket" for y in H.YR_LABELS)
    return _sql(f"grid AS (SELECT * FROM ({bands}) b, ({yrs}) y)",
                """cells AS (SELECT pay_band, yrs_bucket, COUNT(*) AS n, AVG(CAST(is_repost AS DOUBLE)) * 100 AS rate
                FROM l2 WHERE pay_band IS NOT NULL AND yrs_bucket IS NOT NULL GROUP BY pay_band, yrs_bucket)""",
                body=f"""SELECT g.pay_band, g.yrs_bucket, coalesce(c.n, 0) AS n,
                CASE WHEN c.n >= {min_n} THEN c.rate END AS repost_rate_pct
                FROM grid g LEFT JOIN cells c USING (pay_band, yrs_bucket)""")


@register("repost_matrix", _matrix_sql(H.MIN_N))
def q_repost_matrix(spark, sf):
    """H-10: full 4 x 7 grid."""
    return H.repost_matrix(_m(spark, sf))


@register("repost_matrix_floor200", _matrix_sql(200))
def q_repost_matrix_200(spark, sf):
    """H-10 with a floor of 200, so thin cells are blanked on the test tables."""
    return H.repost_matrix(_m(spark, sf), min_n=200)


_CONTRAST = f"""ct AS (
    SELECT pay_band,
        AVG(CAST(is_repost AS DOUBLE)) FILTER (WHERE NOT hi) * 100 AS repost_lt3,
        AVG(CAST(is_repost AS DOUBLE)) FILTER (WHERE hi) * 100 AS repost_gte3,
        COUNT(*) FILTER (WHERE NOT hi) AS n_lt3, COUNT(*) FILTER (WHERE hi) AS n_gte3
    FROM (SELECT *, least(greatest(seniority_years, 0), 15) >= {H.HIGH_EXPERIENCE_YEARS} AS hi FROM l2 WHERE pay_band IS NOT NULL)
    GROUP BY pay_band HAVING COUNT(*) FILTER (WHERE NOT hi) >= {H.MIN_N} AND COUNT(*) FILTER (WHERE hi) >= {H.MIN_N})"""


@register("repost_contrast", _sql(_CONTRAST, body="SELECT pay_band, repost_lt3, repost_gte3, n_lt3 + n_gte3 AS n FROM ct"))
def q_repost_contrast(spark, sf):
    """H-11."""
    return H.repost_contrast(_m(spark, sf))


@register("danger_zone", _sql(_CONTRAST, body="SELECT pay_band, repost_lt3, repost_gte3, n_lt3 + n_gte3 AS n, repost_gte3 > repost_lt3 AS danger_zone FROM ct"))
def q_danger_zone(spark, sf):
    """H-13: danger-zone flag per readable band."""
    return H.danger_zone(H.repost_contrast(_m(spark, sf)))


@register("cohort_sizes", _sql(body="SELECT (SELECT COUNT(*) FROM hm) AS market, (SELECT COUNT(*) FROM l2) AS layer2, (SELECT COUNT(*) FROM fc) AS first_cycle"))
def q_cohort_sizes(spark, sf):
    """H-12."""
    return H.cohort_sizes(_m(spark, sf))


def _wide_sql(value: str, src: str, key: str, fill: str | None = None) -> str:
    cols = []
    for y in H.YR_LABELS:
        e = f"MAX(CASE WHEN yrs_bucket = '{y}' THEN {value} END)"
        cols.append(f"{'coalesce(' + e + ', ' + fill + ')' if fill else e} AS \"{y}\"")
    return f"SELECT {key}, {', '.join(cols)} FROM {src} GROUP BY {key}"


@register("config_norms_wide", _sql(_NORMS, body=_wide_sql("share_pct", "norms", "position_level, level_rank", "0.0")))
def q_config_norms_wide(spark, sf):
    """H-07 crosstab (levels x year buckets, row %)."""
    return H.config_norms_wide(_m(spark, sf))


def _matrix_wide_sql(min_n: int) -> str:
    bands = " UNION ALL ".join(f"SELECT '{b}' AS pay_band, {i + 1} AS band_order" for i, b in enumerate(H.PAY_LABELS))
    yrs = " UNION ALL ".join(f"SELECT '{y}' AS yrs_bucket" for y in H.YR_LABELS)
    return _sql(f"grid AS (SELECT * FROM ({bands}) b, ({yrs}) y)",
                """cells AS (SELECT pay_band, yrs_bucket, COUNT(*) AS n, AVG(CAST(is_repost AS DOUBLE)) * 100 AS rate
                FROM l2 WHERE pay_band IS NOT NULL AND yrs_bucket IS NOT NULL GROUP BY pay_band, yrs_bucket)""",
                f"""rm AS (SELECT g.pay_band, g.band_order, g.yrs_bucket, CASE WHEN c.n >= {min_n} THEN c.rate END AS repost_rate_pct
                FROM grid g LEFT JOIN cells c USING (pay_band, yrs_bucket))""",
                body=_wide_sql("repost_rate_pct", "rm", "pay_band, band_order").replace(
                    "GROUP BY pay_band, band_order", "GROUP BY pay_band, band_order"))


@register("repost_matrix_wide", _matrix_wide_sql(H.MIN_N))
def q_repost_matrix_wide(spark, sf):
    """H-10 grid (pay bands x year buckets), thin cells blank."""
    return H.repost_matrix_wide(_m(spark, sf))


# ---- sector-filtered variants (the hirer picks a sector) ---------------------------

_HS = "Information Technology"


@register("response_by_pay_band_sector", _sql(body=f"""SELECT pay_band, COUNT(*) AS n,
    quantile_cont(applications, 0.1) AS apps_p10, quantile_cont(applications, 0.5) AS apps_p50,
    quantile_cont(applications, 0.9) AS apps_p90, AVG(CAST(applications < vacancies AS DOUBLE)) AS under_filled
    FROM fc WHERE sector = '{_HS}' GROUP BY pay_band HAVING COUNT(*) >= {H.MIN_N}"""))
def q_response_sector(spark, sf):
    """H-08 for one sector."""
    return H.response_by_pay_band(_m(spark, sf), sector=_HS)


@register("repost_contrast_sector", _sql(_CONTRAST.replace("FROM l2 WHERE pay_band IS NOT NULL", f"FROM l2 WHERE pay_band IS NOT NULL AND sector = '{_HS}'"),
                                         body="SELECT pay_band, repost_lt3, repost_gte3, n_lt3 + n_gte3 AS n FROM ct"))
def q_repost_contrast_sector(spark, sf):
    """H-11 for one sector."""
    return H.repost_contrast(_m(spark, sf), sector=_HS)
