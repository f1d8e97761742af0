"""Hirer benchmark operators (H-01..H-13, N-04, N-07).

Benchmarks are grouped aggregates with small-cell suppression. The fallback
ladder (H-06) is a set operation: each request is exploded into its rungs
and equi-joined to one benchmark table that holds every key subset the
ladder can ask for; the best (lowest) rung per request wins. No per-request
Python, no collect.
"""
from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantile import with_exact_median
from ..functions.expr import all_of, clip, right_closed_bins, scalar
from .market import ENGAGEMENT_COUNTER_FREEZE_DATE

# ---- fixed values ------------------------------------------------------------
MIN_N = 30
YR_BINS = [-1, 0, 1, 2, 3, 5, 8, 100]
YR_LABELS = ["0", "1", "2", "3", "4-5", "6-8", "9+"]
PAY_BINS = [-1, 2999, 4999, 7999, 1e12]
PAY_LABELS = ["Entry (< $3k)", "Mid ($3-5k)", "Senior ($5-8k)", "Executive (> $8k)"]
EXP_ORDER = ["Entry Level", "Mid Level", "Senior"]
DIMS = ["sector", "position_level", "experience_level", "yrs_bucket"]
GRAIN_NAMES = {"sector": "sector", "position_level": "level", "experience_level": "experience", "yrs_bucket": "years"}
DROP_ORDER = ["experience_level", "sector", "yrs_bucket", "position_level"]
KEYS_4 = ["sector", "position_level", "experience_level", "yrs_bucket"]
KEYS_3 = ["sector", "position_level", "experience_level"]
KEYS_2 = ["sector", "position_level"]
RARE_SHARE_PCT = 1.0
HIGH_EXPERIENCE_YEARS = 3
# ------------------------------------------------------------------------------

QS = [0.25, 0.5, 0.75]


def yrs_bucket(c="seniority_years") -> Column:
    """H-02: right-closed year buckets 0,1,2,3,4-5,6-8,9+."""
    return right_closed_bins(c, YR_BINS, YR_LABELS)


def pay_band(c="salary_midpoint") -> Column:
    """H-02: right-closed pay bands on the midpoint (2,999.50 falls in Mid)."""
    return right_closed_bins(c, PAY_BINS, PAY_LABELS)


def hirer_market(deduped: DataFrame, cutoff: str = ENGAGEMENT_COUNTER_FREEZE_DATE) -> DataFrame:
    """H-01: deduplicated market with counters_complete, yrs_bucket, pay_band."""
    return deduped.withColumns({
        "counters_complete": F.coalesce(F.col("expiry_date") <= F.to_date(F.lit(cutoff)), F.lit(False)),
        "yrs_bucket": yrs_bucket(),
        "pay_band": pay_band(),
    })


def layer2_cohort(market: DataFrame) -> DataFrame:
    """H-03: counters complete and a 30-day listing."""
    return market.where(F.col("counters_complete") & F.coalesce(F.col("listing_days") == 30, F.lit(False)))


def first_cycle(market: DataFrame, sector: str | None = None) -> DataFrame:
    """First-cycle postings of the layer-2 cohort (never reposted, band known)."""
    c = layer2_cohort(market).where((F.col("repost_count") == 0) & F.col("pay_band").isNotNull())
    return c.where(F.col("sector") == sector) if sector else c


def levels_by_seniority(market: DataFrame) -> DataFrame:
    """H-04: position levels ordered by their median years (level breaks ties);
    ``experience_levels`` order is the fixed EXP_ORDER."""
    g = (market.where(F.col("position_level").isNotNull()).groupBy("position_level")
         .agg(F.median("seniority_years").alias("median_years")))
    return g.withColumn("level_rank", F.row_number().over(Window.orderBy("median_years", "position_level"))).orderBy("level_rank")


def _pcts(col: str, qs=QS) -> Column:
    return F.percentile(F.col(col), F.array(*[F.lit(q) for q in qs]))


def benchmark(frame: DataFrame, keys, min_n: int = MIN_N, extended: bool = False) -> DataFrame:
    """H-05 (N-04 when ``extended``): n and midpoint p25/p50/p75 per cell,
    rounded half-even, cells under ``min_n`` suppressed; null keys dropped."""
    f = frame.where(all_of([F.col(k).isNotNull() for k in keys]))
    aggs = [F.count(F.lit(1)).alias("n"), _pcts("salary_midpoint").alias("_q")]
    if extended:
        aggs += [F.median("salary_min").alias("min_p50"), F.median("salary_max").alias("max_p50"),
                 F.median("seniority_years").alias("yrs_p50")]
    out = f.groupBy(*keys).agg(*aggs)
    out = out.select(*keys, "n",
                     *[F.bround(F.col("_q")[i], 0).alias(n) for i, n in enumerate(["mid_p25", "mid_p50", "mid_p75"])],
                     *([F.bround(c, 0).alias(c) for c in ["min_p50", "max_p50", "yrs_p50"]] if extended else []))
    return out.where(F.col("n") >= min_n)


def salary_benchmark(market: DataFrame, keys, min_n: int = MIN_N) -> DataFrame:
    return benchmark(market.where(F.col("salary_flag") == "ok"), keys, min_n)


def benchmark_coverage(market: DataFrame, keys, min_n: int = MIN_N) -> DataFrame:
    """N-04: extended benchmark plus each cell's coverage of all ok postings (%)."""
    ok = market.where(F.col("salary_flag") == "ok")
    total = scalar(ok.agg(F.count(F.lit(1)).alias("_total")), "_total")
    b = benchmark(ok, keys, min_n, extended=True)
    return b.withColumn("coverage_pct", F.col("n") * 100.0 / total)


# ---- H-06 ladder -------------------------------------------------------------

def ladder(specified: list[str]) -> list[list[str]]:
    """The rungs of a request that fixes ``specified``: rung j keeps its dimensions from
    place j of the drop order on."""
    asked = [d for d in DROP_ORDER if d in specified]
    return [[d for d in DIMS if d in asked[j:]] for j in range(len(asked))]


def _mask(dims) -> int:
    return sum(1 << DIMS.index(d) for d in dims)


def _subsets():
    return [list(c) for r in range(1, 5) for c in combinations(DIMS, r)]


def benchmark_cells(ok: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Every key subset's benchmark in one table: ``mask`` names the subset,
    dims outside it are null. Built from a (cell, value) histogram -- one
    shuffle that collapses repeated values -- and weighted percentiles over
    grouping sets of that histogram, so the raw rows are aggregated once."""
    hist = (ok.groupBy(*DIMS, "salary_midpoint").agg(F.count(F.lit(1)).alias("w")))
    cells = (hist.groupingSets(_subsets(), *DIMS)
             .agg(*[F.grouping(d).alias(f"_g{i}") for i, d in enumerate(DIMS)],
                  F.sum("w").cast("long").alias("n"),
                  F.percentile(F.col("salary_midpoint"), F.array(*[F.lit(q) for q in QS]), F.col("w")).alias("q")))
    mask = reduce(lambda a, b: a + b, [(1 - F.col(f"_g{i}")) * (1 << i) for i in range(len(DIMS))])
    cells = cells.withColumn("mask", mask.cast("int"))
    # a grouped dim with a null value is a null key: such cells are dropped
    kept = all_of([((F.col("mask").bitwiseAND(1 << i)) == 0) | F.col(d).isNotNull() for i, d in enumerate(DIMS)])
    return (cells.where(kept & (F.col("n") >= min_n))
            .select(*DIMS, "mask", "n", *[F.bround(F.col("q")[i], 0).alias(n)
                                         for i, n in enumerate(["mid_p25", "mid_p50", "mid_p75"])]))


def salary_lookup(market: DataFrame, requests: DataFrame, min_n: int = MIN_N, store=None) -> DataFrame:
    """H-06: for each request (``request_id`` + any of the four dims, null =
    not narrowed), the benchmark of the most specific rung with a cell of at
    least ``min_n``; else the global ok-salary figures (unrounded). The ladder runs
    once per distinct configuration; other columns of the requests are kept. ``store`` (rows
    -> the written rows) keeps the configurations' answers, so that the planner knows their
    bytes and need not deal out the requests by configuration."""
    ok = market.where(F.col("salary_flag") == "ok")
    cells = benchmark_cells(ok, min_n)
    spec = reduce(lambda a, b: a + b, [F.when(F.col(d).isNotNull(), 1 << i).otherwise(0) for i, d in enumerate(DIMS)])
    # static map: specified-mask -> array of (rung_no, rung_mask, grain)
    entries = []
    for m in range(16):
        dims = [d for i, d in enumerate(DIMS) if m & (1 << i)]
        rungs = [F.struct(F.lit(j).alias("rung_no"), F.lit(_mask(r)).alias("rung_mask"),
                          F.lit(" + ".join(GRAIN_NAMES[k] for k in r)).alias("grain"))
                 for j, r in enumerate(ladder(dims))]
        entries += [F.lit(m), F.array(*rungs) if rungs else
                    F.array().cast("array<struct<rung_no:int,rung_mask:int,grain:string>>")]
    rung_map = F.create_map(*entries)
    asked = [f"_c_{d}" for d in DIMS]
    configs = requests.select(*DIMS).distinct().withColumn("_spec", spec)
    exploded = (configs.select(*[F.col(d).alias(c) for d, c in zip(DIMS, asked)], F.explode(F.element_at(rung_map, F.col("_spec"))).alias("r"))
                .select(*asked, "r.rung_no", "r.rung_mask", "r.grain",
                        *[F.when((F.col("r.rung_mask").bitwiseAND(1 << i)) != 0, F.col(c)).alias(d)
                          for i, (d, c) in enumerate(zip(DIMS, asked))]))
    cond = (exploded.rung_mask == cells.mask) & reduce(
        lambda a, b: a & b, [exploded[d].eqNullSafe(cells[d]) for d in DIMS])
    matched = (exploded.join(cells, cond)
               .select(*asked, "rung_no", "grain", "n", "mid_p25", "mid_p50", "mid_p75"))
    best = (matched.groupBy(*asked)
            .agg(F.min(F.struct("rung_no", "grain", "n", "mid_p25", "mid_p50", "mid_p75")).alias("b"))
            .select(*asked, "b.grain", "b.n", "b.mid_p25", "b.mid_p50", "b.mid_p75"))
    best = store(best) if store else best
    glob = ok.agg(F.count(F.lit(1)).alias("g_n"), _pcts("salary_midpoint").alias("g_q"))
    g_n, g_q = scalar(glob, "g_n"), scalar(glob, "g_q")
    same = reduce(lambda a, b: a & b, [requests[d].eqNullSafe(best[c]) for d, c in zip(DIMS, asked)])
    others = [c for c in requests.columns if c not in ("request_id", *DIMS)]
    out = (requests.withColumn("_spec", spec).join(best, same, "left")
           .select("request_id", *DIMS, *others,
                   F.coalesce(F.col("grain"), F.when(F.col("_spec") == 0, F.lit("all postings"))
                              .otherwise(F.lit("all postings (no comparable cell)"))).alias("grain"),
                   F.coalesce(F.col("n"), g_n).alias("n"),
                   F.when(F.col("grain").isNotNull(), F.col("mid_p25")).otherwise(g_q[0]).alias("mid_p25"),
                   F.when(F.col("grain").isNotNull(), F.col("mid_p50")).otherwise(g_q[1]).alias("mid_p50"),
                   F.when(F.col("grain").isNotNull(), F.col("mid_p75")).otherwise(g_q[2]).alias("mid_p75")))
    return out


def salary_position_flag(lookup: DataFrame, salary_col: str = "salary") -> DataFrame:
    """H-13: a planned salary below p25 / above p75 of its looked-up benchmark."""
    s = F.col(salary_col)
    return lookup.withColumn("salary_position", F.when(s < F.col("mid_p25"), "below_p25")
                             .when(s > F.col("mid_p75"), "above_p75").otherwise("within"))


def config_norms(market: DataFrame, sector: str | None = None, min_n: int = MIN_N) -> DataFrame:
    """H-07 (long form): row-% of each level's postings per year bucket, levels
    under ``min_n`` dropped, ``level_rank`` by median years; ``rare`` marks
    pairs under 1 %."""
    m = market.where(F.col("sector") == sector) if sector else market
    m = m.where(F.col("position_level").isNotNull() & F.col("yrs_bucket").isNotNull())
    cell = m.groupBy("position_level", "yrs_bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("position_level")
    ranks = levels_by_seniority(market).select("position_level", "level_rank")
    out = (cell.withColumn("level_n", F.sum("n").over(w))
           .where(F.col("level_n") >= min_n)
           .withColumn("share_pct", F.col("n") * 100.0 / F.col("level_n"))
           .join(ranks, "position_level", "left"))
    return out.withColumn("rare", F.col("share_pct") < RARE_SHARE_PCT)


def response_by_pay_band(market: DataFrame, sector: str | None = None, min_n: int = MIN_N) -> DataFrame:
    """H-08: first-cycle n, applications p10/p50/p90 and under-filled share per band."""
    f = first_cycle(market, sector)
    g = f.groupBy("pay_band").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile(F.col("applications"), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"),
        F.avg((F.col("applications") < F.col("vacancies")).cast("double")).alias("under_filled"))
    return (g.select("pay_band", "n", F.col("_q")[0].alias("apps_p10"), F.col("_q")[1].alias("apps_p50"),
                     F.col("_q")[2].alias("apps_p90"), "under_filled")
            .where(F.col("n") >= min_n))


def funnel_by_pay_band(market: DataFrame, sector: str | None = None, min_n: int = MIN_N) -> DataFrame:
    """H-09: median views and median applications/views (0 views -> null) per band."""
    f = first_cycle(market, sector).withColumn(
        "conversion", F.try_divide(F.col("applications").cast("double"), F.nullif(F.col("views"), F.lit(0))))
    bands = f.groupBy("pay_band").agg(F.count(F.lit(1)).alias("n"), F.median("views").alias("views_p50"))
    return (with_exact_median(bands, f, ["pay_band"], "conversion", "conversion_p50")
            .withColumn("conversion_pct", F.col("conversion_p50") * 100)
            .where(F.col("n") >= min_n))


def repost_matrix(market: DataFrame, sector: str | None = None, min_n: int = MIN_N) -> DataFrame:
    """H-10: repost % per pay band x year bucket; the full 4 x 7 grid is kept
    (grid = cross join of the two fixed label lists, 28 rows), cells under
    ``min_n`` blank."""
    pool = layer2_cohort(market)
    pool = pool.where(F.col("sector") == sector) if sector else pool
    spark = market.sparkSession
    grid = spark.createDataFrame([(b, y) for b in PAY_LABELS for y in YR_LABELS], "pay_band string, yrs_bucket string")
    cells = (pool.where(F.col("pay_band").isNotNull() & F.col("yrs_bucket").isNotNull())
             .groupBy("pay_band", "yrs_bucket")
             .agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("is_repost").cast("double")) * 100).alias("rate")))
    return (grid.join(cells, ["pay_band", "yrs_bucket"], "left")
            .select("pay_band", "yrs_bucket", F.coalesce(F.col("n"), F.lit(0)).alias("n"),
                    F.when(F.col("n") >= min_n, F.col("rate")).alias("repost_rate_pct")))


def repost_contrast(market: DataFrame, sector: str | None = None, min_n: int = MIN_N) -> DataFrame:
    """H-11: repost % below vs at-or-above 3 years (clipped 0..15) per band,
    both sides at least ``min_n``."""
    pool = layer2_cohort(market)
    pool = pool.where(F.col("sector") == sector) if sector else pool
    pool = pool.where(F.col("pay_band").isNotNull())
    hi = clip("seniority_years", 0, 15) >= HIGH_EXPERIENCE_YEARS
    r = F.col("is_repost").cast("double")
    g = pool.groupBy("pay_band").agg(
        (F.avg(F.when(~hi, r)) * 100).alias("repost_lt3"), (F.avg(F.when(hi, r)) * 100).alias("repost_gte3"),
        F.count(F.when(~hi, 1)).alias("n_lt3"), F.count(F.when(hi, 1)).alias("n_gte3"))
    return (g.where((F.col("n_lt3") >= min_n) & (F.col("n_gte3") >= min_n))
            .select("pay_band", "repost_lt3", "repost_gte3", (F.col("n_lt3") + F.col("n_gte3")).alias("n")))


def danger_zone(contrast: DataFrame) -> DataFrame:
    """H-13: bands where 3+ year postings repost more than the rest."""
    return contrast.withColumn("danger_zone", F.col("repost_gte3") > F.col("repost_lt3"))


def cohort_sizes(market: DataFrame) -> DataFrame:
    """H-12: market, layer-2 and first-cycle sizes in one pass."""
    l2 = F.col("counters_complete") & F.coalesce(F.col("listing_days") == 30, F.lit(False))
    fc = l2 & (F.col("repost_count") == 0) & F.col("pay_band").isNotNull()
    return market.agg(F.count(F.lit(1)).alias("market"),
                      F.count(F.when(l2, 1)).alias("layer2"),
                      F.count(F.when(fc, 1)).alias("first_cycle"))


def config_norms_wide(market: DataFrame, sector: str | None = None, min_n: int = MIN_N) -> DataFrame:
    """H-07 as the row-% crosstab: one row per readable level, one column per
    year bucket (pivot with the fixed bucket list; an unused bucket is 0 %)."""
    long = config_norms(market, sector, min_n)
    wide = long.groupBy("position_level", "level_rank").pivot("yrs_bucket", YR_LABELS).agg(F.max("share_pct"))
    return wide.fillna(0.0, subset=YR_LABELS).orderBy("level_rank")


def repost_matrix_wide(market: DataFrame, sector: str | None = None, min_n: int = MIN_N) -> DataFrame:
    """H-10 as the band x years grid: one row per pay band (all four, fixed
    order), one column per year bucket; thin cells stay blank (null)."""
    long = repost_matrix(market, sector, min_n)
    order = F.array_position(F.array(*[F.lit(b) for b in PAY_LABELS]), F.col("pay_band"))
    return (long.groupBy("pay_band").pivot("yrs_bucket", YR_LABELS).agg(F.max("repost_rate_pct"))
            .withColumn("band_order", order.cast("int")).orderBy("band_order"))
