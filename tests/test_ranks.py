"""Ranks by range and their lookup against plain windows."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vacanta.functions.ranks import counts_below, look_up
from vacanta.operators import stats as S
from vacanta.plans import params as P
from vacanta.plans.postings import Postings
from vacanta.operators.benchmark import hirer_market
from vacanta.session import stored
from conftest import SF_SMALL


def test_counts_below_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(g, rng.gauss(0, 1), rng.randrange(5)) for g in range(3) for _ in range(500 * (g + 1))] + [(3, 1.0, 7)]
    df = spark.createDataFrame(rows, "g int, v double, n long").dropDuplicates(["g", "v"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = stored(counts_below(df, "g", "v", ["n"]), "below")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("below_n", F.coalesce(F.sum("n").over(w), F.lit(0)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_look_up_with_rare_values(spark):
    """Columns with more values than the shared table takes: frequent ones from it, the rest by join."""
    rng = random.Random(2)
    rows = [(float(rng.choice([0, 0, 0, 1, rng.randrange(400)])), float(rng.randrange(3)), rng.choice([None, float(rng.randrange(300))])) for _ in range(3000)]
    df = stored(spark.createDataFrame(rows, "a double, b double, c double"), "rows")
    cols = ["a", "b", "c"]
    ranks = stored(df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("v")) for i, c in enumerate(cols)])).alias("x"))
                   .where("x.v IS NOT NULL").groupBy("x.col", "x.v").agg(F.count("*").alias("n")).withColumn("r", F.col("v") * 10 + F.col("col")), "ranks")
    sizes = {r["col"]: (r["k"], r["m"]) for r in ranks.groupBy("col").agg(F.count("*").alias("k"), F.sum("n").alias("m")).collect()}
    for shared in (5, 50, 10_000):
        got = look_up(df, cols, ranks, ["r"], "n", sizes, shared)
        assert got.count() == 3000
        for i, c in enumerate(cols):
            assert got.where(~F.col(f"r_{c}").eqNullSafe(F.col(c) * 10 + i)).count() == 0


def test_spearman_does_not_depend_on_the_shared_bound(spark):
    market = hirer_market(Postings(spark, SF_SMALL).deduped(), cutoff=P.CUTOFF)
    one, two = ({(r[0], r[1]): r[2] for r in S.spearman_matrix(market, shared=n).collect()} for n in (20_000, 3))
    assert one.keys() == two.keys() and all((a is None) == (two[k] is None) and (a is None or abs(a - two[k]) < 1e-12) for k, a in one.items())
