"""View invariants in the style of the reference's view tests, on the sf0.01 binding."""
import pytest
from pyspark.sql import functions as F

from vacanta.operators import enrich as E
from vacanta.operators import market as M
from vacanta.operators import seeker as K
from vacanta.plans import params as P
from vacanta.plans.postings import Postings
from vacanta.sources.io import fact_contract

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def p(spark):
    return Postings(spark, SF)


@pytest.fixture(scope="module")
def d(p):
    return p.deduped()


def test_market_filter_combinations(d):
    n_all = d.where(M.market_filter()).count()
    n_sector = d.where(M.market_filter("Engineering")).count()
    n_both = d.where(M.market_filter("Engineering", "Manager")).count()
    assert n_all > n_sector > n_both > 0


def test_headline_sector_filter_reduces_total(d):
    full = M.headline(d).collect()[0]
    one = M.headline(d, "Engineering").collect()[0]
    assert full["total_postings"] > one["total_postings"] > 0 and full["median_pay"] is not None


def test_industry_ranking_limit_order_and_filter(d):
    rows = M.industry_ranking(d, limit=3).collect()
    assert len(rows) == 3
    counts = [r["postings"] for r in M.industry_ranking(d).collect()]
    assert counts == sorted(counts, reverse=True)
    assert M.industry_ranking(d, sector="Engineering").count() == 1


def test_momentum_month_counts_capped(d):
    for r in M.industry_momentum(d).collect():
        assert r["recent_month_count"] <= 3 and r["prior_month_count"] <= 3


def test_trend_and_seasonality_order(d):
    months = [r["month"] for r in M.salary_trend(d).collect()]
    assert months == sorted(months)
    s = M.seasonality(d).collect()
    assert [r["month_num"] for r in s] == list(range(1, 13))
    n_years = d.select(F.year("posting_date")).distinct().count()
    assert all(1 <= r["years_included"] <= n_years for r in s)


def test_levels_sorted_descending(d):
    counts = [r["postings"] for r in M.level_ranking(d).collect()]
    assert counts == sorted(counts, reverse=True) and len(counts) == 5


def test_wage_decomposition_bounds(d):
    r = M.wage_decomposition(d, size=P.WINDOW_MONTHS, min_segment=P.MIN_SEGMENT, start=P.RAMP_START).collect()[0]
    assert r["n_early_total"] <= r["total_early_all"] and r["n_late_total"] <= r["total_late_all"]
    assert r["n_segments"] == 30
    tight = M.wage_decomposition(d, size=P.WINDOW_MONTHS, min_segment=10 ** 6, start=P.RAMP_START).collect()[0]
    assert tight["n_segments"] == 0 and tight["actual_early"] is None
    narrow = M.wage_decomposition(d, sector="Engineering", position_level="Manager", size=60,
                                  min_segment=1, start=P.RAMP_START)
    assert narrow.count() == 0


def test_mix_shift_sorted_and_limited(d):
    rows = M.sector_mix_shift(d, limit=4, size=P.WINDOW_MONTHS, start=P.RAMP_START).collect()
    changes = [abs(r["share_change_pct"]) for r in rows]
    assert len(rows) == 4 and changes == sorted(changes, reverse=True)


def test_employment_mix_cohorts_present(d):
    rows = M.employment_mix(d).collect()
    types = {r["job_type"] for r in rows}
    assert {"Permanent", "Contract"} <= types
    counts = [r["postings"] for r in rows]
    assert counts == sorted(counts, reverse=True)


def test_top_companies_share_of_full_population(d):
    rows = M.top_companies(d, limit=5).collect()
    total = d.where(M.market_filter()).count()
    assert len(rows) == 5
    for r in rows:
        assert abs(r["share_pct"] - r["postings"] * 100.0 / total) < 1e-9
    counts = [r["postings"] for r in rows]
    assert counts == sorted(counts, reverse=True)


def test_repost_rate_percent_and_floor(d):
    rows = M.repost_rate_by_sector(d, min_n=P.MIN_COHORT, cutoff=P.CUTOFF).collect()
    assert rows and all(0 <= r["repost_rate_pct"] <= 100 and r["n"] >= P.MIN_COHORT for r in rows)
    narrowed = M.repost_rate_by_sector(d, position_level="Manager", min_n=P.MIN_COHORT, cutoff=P.CUTOFF).count()
    assert narrowed <= len(rows)


def test_exposure_nonnegative(p):
    rows = M.exposure_by_sector(p.finance()).collect()
    assert rows and all(r["median_exposure_per_opening"] >= 0 for r in rows)


def test_seeker_benchmarks(p):
    base = K.seeker_base(p.jobs())
    lb = K.label_benchmarks(base)
    assert set(lb.columns) >= {"job_label", "experience_level", "p25", "median_entry", "median_max", "p90", "count_samples"}
    assert lb.where("p25 IS NULL").count() == 0
    tot = lb.groupBy("job_label").agg(F.sum("count_samples").alias("t"))
    assert tot.where(f"t < {K.MIN_BENCHMARK_SAMPLE}").count() == 0
    narrowed = K.seeker_base(p.jobs(), experience_level="Senior").count()
    assert 0 < narrowed < base.count()


def test_fact_schema_contract(p):
    jobs = p.jobs()
    report = E.schema_report(jobs)
    assert report.where("kind = 'missing'").count() == 0
    out, missing = fact_contract(jobs)
    hirer_reads = ["dup_group_id", "sector", "position_level", "experience_level", "seniority_years",
                   "salary_midpoint", "salary_flag", "expiry_date", "listing_days", "views", "applications",
                   "vacancies", "repost_count", "is_repost"]
    assert set(hirer_reads) <= set(out.columns) and missing == []
