"""The event sweep against a dense calendar, and dates that would inflate one."""
import random
from datetime import date, timedelta
from statistics import median

from vacanta.operators.stats import competition_density

SCHEMA = "sector string, position_level string, posting_date date, expiry_date date"


def dense(rows, warmup):
    """Live postings per group and day, counted day by day."""
    first = min(p for *_, p, _ in rows if p)
    close = min(max(p for *_, p, _ in rows if p), max(e for *_, e in rows if e))
    days = [first + timedelta(n) for n in range(warmup, (close - first).days + 1)]
    groups = {(s, l) for s, l, p, e in rows if s and l and (p or e)}
    return {g: {d: sum((p is not None and p <= d) - (e is not None and first <= e <= d) for s, l, p, e in rows if (s, l) == g) for d in days} for g in groups}


def test_sweep_equals_calendar(spark):
    rng, start = random.Random(6), date(2023, 1, 1)
    rows = []
    for _ in range(200):
        p = start + timedelta(rng.randrange(90))
        rows.append((rng.choice(["a", "b", None]), rng.choice(["x", "y"]), p, rng.choice([None, p + timedelta(rng.randrange(1, 40))])))
    rows += [("c", "x", None, start + timedelta(50)), ("c", "y", start - timedelta(0), start - timedelta(5)), ("d", "x", start + timedelta(89), None)]
    for extra in ([], [("a", "x", start, date(9999, 12, 31))]):
        given = spark.createDataFrame(rows + extra, SCHEMA)
        live = dense(rows + extra, 10)
        got = {(r[0], r[1]): r[2] for r in competition_density(given, warmup=10).collect()}
        assert got == {g: median(days.values()) for g, days in live.items()}
        total = {r["day"]: r["total_live"] for r in competition_density(given, warmup=10, daily=True).collect()}
        assert total == {d: sum(days[d] for days in live.values()) for d in next(iter(live.values()))}


def test_a_far_date_adds_no_rows(spark):
    """The plan holds event days only: no calendar is generated for the medians."""
    given = spark.createDataFrame([("a", "x", date(2023, 1, 1), date(9999, 12, 31)), ("a", "x", date(2023, 3, 1), date(2023, 4, 1))], SCHEMA)
    plan = competition_density(given)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "Generate" not in plan


def test_no_postings(spark):
    assert competition_density(spark.createDataFrame([], SCHEMA)).count() == 0
