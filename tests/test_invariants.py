"""Query invariants from the reference's view tests, on the sf0.001 binding."""
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vacanta.functions.stats import chi2_sf, erfc, normal_two_sided_p
from vacanta.operators import benchmark as H
from vacanta.operators import market as M
from vacanta.operators import seeker as K
from vacanta.plans import params as P
from vacanta.plans.postings import Postings


@pytest.fixture(scope="module")
def deduped(spark):
    return Postings(spark, SF_SMALL).deduped()


def test_pct_change_edge_cases(spark):
    df = spark.createDataFrame([("a", 120.0, 100.0), ("b", 50.0, 0.0), ("c", 50.0, None), ("d", None, 100.0)],
                               "sector string, recent_avg_monthly double, prior_avg_monthly double")
    pct = F.when(F.col("prior_avg_monthly").isNotNull() & (F.col("prior_avg_monthly") != 0),
                 100 * (F.col("recent_avg_monthly") - F.col("prior_avg_monthly")) / F.col("prior_avg_monthly"))
    got = {r[0]: r[1] for r in df.select("sector", F.bround(pct, 1)).collect()}
    assert got == {"a": 20.0, "b": None, "c": None, "d": None}


def test_wage_effects_additive(deduped):
    r = M.wage_decomposition(deduped, size=P.ENTRY_WINDOW_MONTHS, min_segment=P.MIN_SEGMENT, start=P.RAMP_START).collect()
    assert len(r) == 1 and r[0]["n_segments"] == 18
    row = r[0]
    assert math.isclose(row["within_effect"] + row["mix_effect"], row["total_change"], abs_tol=1e-6)


def test_windows_disjoint_and_sized(deduped):
    w = M.early_late_months(deduped, size=3, start=P.RAMP_START).collect()
    early = {r["ym"] for r in w if r["window"] == "early"}
    late = {r["ym"] for r in w if r["window"] == "late"}
    assert len(early) == 3 and len(late) == 3 and not early & late and max(early) < min(late)


def test_too_few_months_gives_no_row(deduped):
    assert M.wage_decomposition(deduped, size=400, min_segment=1, start=P.RAMP_START).count() == 0


def test_shares_sum_to_100(deduped):
    s = M.sector_mix_shift(deduped, limit=100, size=3, start=P.RAMP_START)
    tot = s.agg(F.sum("share_early_pct"), F.sum("share_late_pct")).collect()[0]
    assert math.isclose(tot[0], 100.0, abs_tol=1e-6) and math.isclose(tot[1], 100.0, abs_tol=1e-6)


def test_rankings_sorted(deduped):
    rows = M.industry_ranking(deduped).collect()
    counts = [r["postings"] for r in rows]
    assert counts == sorted(counts, reverse=True)


def test_benchmark_floor(deduped):
    m = H.hirer_market(deduped, cutoff=P.CUTOFF)
    b = H.salary_benchmark(m, H.KEYS_2, min_n=10)
    assert b.where("n < 10").count() == 0


def test_repost_grid_shape(deduped):
    m = H.hirer_market(deduped, cutoff=P.CUTOFF)
    g = H.repost_matrix(m, min_n=30)
    assert g.count() == len(H.PAY_LABELS) * len(H.YR_LABELS)
    assert g.where("n < 30 AND repost_rate_pct IS NOT NULL").count() == 0


def test_label_benchmark_floor(spark):
    jobs = Postings(spark, SF_SMALL).jobs()
    lb = K.label_benchmarks(K.seeker_base(jobs), min_total=50)
    tot = lb.groupBy("job_label").agg(F.sum("count_samples").alias("t"))
    assert tot.where("t < 50").count() == 0


def test_percentile_matches_brute_force(spark):
    jobs = Postings(spark, SF_SMALL).jobs()
    base = K.seeker_base(jobs)
    req = base.select("sector", "experience_level", F.col("market_salary").alias("salary")).limit(25)
    fast = {(r["sector"], r["experience_level"], r["salary"]): r["percentile"]
            for r in K.salary_percentile(base, req, decimals=None).collect()}
    rows = base.select("sector", "experience_level", "market_salary").collect()
    for (s, e, v), pct in fast.items():
        sl = [r["market_salary"] for r in rows if r["sector"] == s and r["experience_level"] == e]
        assert math.isclose(pct, 100.0 * sum(x <= v for x in sl) / len(sl), rel_tol=1e-12)


def test_distribution_functions(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.3, 1.0, 2.5, -0.7]], "x double")
    for r in df.select("x", erfc(F.col("x")).alias("e")).collect():
        assert abs(r["e"] - math.erfc(r["x"])) < 2e-7 * max(1.0, math.erfc(r["x"]))
    pts = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251178, 3),
                                 (9.487729036781154, 4)], "x double, k int")
    for r in pts.select(chi2_sf(F.col("x"), F.col("k")).alias("p")).collect():
        assert abs(r["p"] - 0.05) < 1e-6
    z = spark.createDataFrame([(1.959963984540054,)], "z double").select(normal_two_sided_p(F.col("z"))).collect()[0][0]
    assert abs(z - 0.05) < 1e-6


def test_approximate_variants_close_to_exact(spark):
    """approx=True swaps exact percentiles / distinct counts for sketches; on
    the test tables they must stay close to the exact figures."""
    from vacanta.operators import enrich as E
    from vacanta.operators import finance as P_
    from vacanta.operators import quality as Q
    p = Postings(spark, SF_SMALL)
    jobs = p.jobs()
    base = jobs.drop("competitiveness_score")
    ex = E.competitiveness(base).select("job_id", F.col("competitiveness_score").alias("e"))
    ap = E.competitiveness(base, approx=True).select("job_id", F.col("competitiveness_score").alias("a"))
    worst = ex.join(ap, "job_id").agg(F.max(F.abs(F.col("e") - F.col("a")))).collect()[0][0]
    assert worst < 5.0
    fin = p.finance().select("job_id", "salary_midpoint_monthly")
    e2 = P_.planning_salary(fin).agg(F.max("planning_salary_midpoint_monthly")).collect()[0][0]
    a2 = P_.planning_salary(fin, approx=True).agg(F.max("planning_salary_midpoint_monthly")).collect()[0][0]
    assert abs(e2 - a2) / e2 < 0.1
    exact = {r["column_name"]: r["distinct_values"] for r in Q.column_profile(p.raw()).collect()}
    approx = {r["column_name"]: r["distinct_values"] for r in Q.column_profile(p.raw(), approx=True).collect()}
    # HyperLogLog++ default relative standard deviation is 5 %: allow three of them
    assert all(abs(exact[c] - approx[c]) <= max(2, 0.15 * exact[c]) for c in exact)
