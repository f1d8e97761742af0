"""Exact medians against the aggregate that holds a group in one task."""
import random

from pyspark.sql import functions as F

from vacanta.functions.quantile import with_exact_median


def test_equals_median(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, rng.gauss(0, 1), float(rng.randrange(5))])) for k in ("a", "b", None) for _ in range(700)]
    rows += [("one", 1.5), ("two", 1.0), ("two", 4.0), ("none", None)] + [("same", 7.0)] * 9
    rows += [("hot", rng.random()) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "k string, v double")
    groups = df.groupBy("k").agg(F.median("v").alias("want"))
    for r in with_exact_median(groups, df, ["k"], "v", "got").collect():
        assert r.got == r.want or abs(r.got - r.want) < 1e-12, r
    one = with_exact_median(df.agg(F.median("v").alias("want")), df, [], "v", "got").first()
    assert abs(one.got - one.want) < 1e-12
    assert with_exact_median(df.limit(0).agg(F.median("v").alias("want")), df.limit(0), [], "v", "got").first().got is None


def exact(spark, rows, most):
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    groups = df.groupBy("k").agg(F.median("v").alias("want"))
    for r in with_exact_median(groups, df, ["k"], "v", "got", most=most).collect():
        assert r.got == r.want or abs(r.got - r.want) <= 1e-12 * abs(r.want), (most, r)


def test_selection_by_rounds(spark):
    """Brackets narrow until few values are left, whatever the values' spread."""
    rng = random.Random(9)
    rows = [("exponential", 10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1])) for _ in range(6000)]
    rows += [("one value", 3.0) for _ in range(4000)] + [("mostly one", rng.choice([3.0, 3.0, 3.0, rng.random()])) for _ in range(4000)]
    rows += [("two values", rng.choice([1.0, 2.0])) for _ in range(4001)] + [("halves", float(k < 2000)) for k in range(4000)]
    rows += [("steps", float(int(rng.random() * 40))) for _ in range(5000)] + [("close", 1.0 + k * 2e-16) for k in range(3000)]
    rows += [(None, rng.gauss(0, 1e-9)) for _ in range(5001)] + [("small", 1.0), ("small", 2.0), ("none", None)]
    for most in (2, 30, 3500):
        exact(spark, rows, most)


def test_selection_over_all_rows(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.expovariate(1),) for _ in range(9001)], "v double")
    whole = df.agg(F.median("v").alias("want"))
    r = with_exact_median(whole, df, [], "v", "got", most=50).first()
    assert r.got == r.want


def test_wrong_proposals_change_nothing(spark, monkeypatch):
    """An end that the counts refute is not taken: with a useless sketch the rounds end in an error, never in a wrong value."""
    import pytest

    from vacanta.functions import quantile
    monkeypatch.setattr(quantile, "MAX_ROUNDS", 2)
    monkeypatch.setattr(quantile, "MARGIN", -0.3)  # both ends on the wrong side of the median
    df = spark.createDataFrame([("a", float(k)) for k in range(2000)], "k string, v double")
    with pytest.raises(RuntimeError):
        with_exact_median(df.groupBy("k").agg(F.median("v").alias("want")), df, ["k"], "v", "got", most=100)
