"""Exact medians of columns with unbounded distinct values, by distributed selection.

``percentile`` keeps every distinct value of a group in one task. Here no task holds more
than ``MOST`` values of a group:

1. A group of at most ``MOST`` rows has its distinct values ranked at once.
2. For the others a round narrows the bracket that holds the middle ranks: a mergeable
   quantile sketch of the values inside proposes new ends, and one pass counts exactly how
   many rows lie below, at and between them. An end is taken only if the counts prove that the wanted
   ranks lie within it; else the old end stays. Sketch and counts are combined per task
   before the shuffle, so a hot group costs no more than another.
3. Rounds go on until at most ``MOST`` rows of any group lie strictly inside its bracket.
   Rows equal to an end are only counted, so one value that fills the middle ends its group.

A round keeps about 0.3 % of the rows: two rounds serve 10^11 rows of one group.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Values of one group that a task may rank.
MOST = 1_000_000
#: The sketch gives its quantiles at this many equal steps, each within 1 / ACCURACY of its
#: rank; a bracket's ends stand off the wanted ranks by MARGIN of the rows and the next step.
STEPS, ACCURACY, MARGIN = 1000, 10_000, 0.0005
MAX_ROUNDS = 50


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys``, nulls equal; the keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def _inside(v: str = "_v") -> Column:
    return (F.col("_lo").isNull() | (F.col(v) > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col(v) < F.col("_hi")))


def _brackets(values: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """Per group its row count _n, the ends _lo and _hi (null: open) of a bracket that holds
    both middle ranks, the rows up to _lo, and those strictly inside; None if no group has
    more than ``most`` rows."""
    counts = values.groupBy(*keys).agg(F.count("*").alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) <= most:
        return None
    nothing = F.lit(None).cast("double")
    state = stored(counts.select(*keys, "_n", nothing.alias("_lo"), nothing.alias("_hi"), F.lit(0).cast("long").alias("_upto"),
                                 F.col("_n").alias("_within")), "brackets")
    first, last = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    for _ in range(MAX_ROUNDS):
        wide = state.where(F.col("_within") > most)
        if wide.isEmpty():
            return state
        held = _joined(values, wide, keys, "inner").where(_inside())
        grid = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
        sketch = held.groupBy(*keys).agg(F.percentile_approx("_v", grid, ACCURACY).alias("_sketch"))
        low = F.floor(((first - F.col("_upto")) / F.col("_within") - MARGIN) * STEPS).cast("int")
        high = F.ceil(((last + 1 - F.col("_upto")) / F.col("_within") + MARGIN) * STEPS).cast("int")
        proposed = stored(_joined(wide, sketch, keys, "inner").select(
            *keys, "_n", "_lo", "_hi", "_upto", "_within", F.when(low > 0, F.get("_sketch", low)).alias("_a"),
            F.when(high < STEPS, F.get("_sketch", high)).alias("_b")), "proposed")
        seen = (_joined(values, proposed, keys, "inner").where(_inside()).groupBy(*keys)
                .agg(*[F.count_if(c).alias(n) for n, c in (("_lt_a", F.col("_v") < F.col("_a")), ("_le_a", F.col("_v") <= F.col("_a")),
                                                           ("_lt_b", F.col("_v") < F.col("_b")), ("_le_b", F.col("_v") <= F.col("_b")))]))
        # The value of the first wanted rank is not below _a, that of the last not above _b.
        met = _joined(proposed, seen, keys, "inner")
        up = F.coalesce(F.col("_upto") + F.col("_lt_a") <= first, F.lit(False)) & F.col("_a").isNotNull()
        down = F.coalesce(F.col("_upto") + F.col("_le_b") > last, F.lit(False)) & F.col("_b").isNotNull()
        upto = F.when(up, F.col("_upto") + F.col("_le_a")).otherwise(F.col("_upto"))
        below_end = F.when(down, F.col("_upto") + F.col("_lt_b")).otherwise(F.col("_upto") + F.col("_within"))
        narrowed = met.select(*keys, "_n", F.when(up, F.col("_a")).otherwise(F.col("_lo")).alias("_lo"),
                              F.when(down, F.col("_b")).otherwise(F.col("_hi")).alias("_hi"), upto.alias("_upto"),
                              F.greatest(below_end - upto, F.lit(0)).alias("_within"))
        state = stored(state.where(F.col("_within") <= most).unionByName(narrowed), "brackets")
    raise RuntimeError(f"brackets of {keys} did not narrow in {MAX_ROUNDS} rounds")


def with_exact_median(groups: DataFrame, rows: DataFrame, keys: list[str], value: str, name: str, most: int = MOST) -> DataFrame:
    """``groups`` (one row per group of ``keys``) with the median of ``value`` over each
    group's ``rows`` as ``name``: linear between the two middle values, null without any.
    Counting the groups is an action; no other runs unless one has over ``most`` rows."""
    keyed = keys or ["_all"]
    values = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if not keys:
        values = values.withColumn("_all", F.lit(0))
    state = _brackets(values, keyed, max(most, 2))  # two ranks may be wanted
    by_value = Window.partitionBy(*keyed).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    if state is None:
        ranked = (values.groupBy(*keyed, "_v").agg(F.count("*").alias("_c"))
                  .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keyed))).withColumn("_rank", F.sum("_c").over(by_value)))
    else:
        if not keys:
            state = F.broadcast(state)  # one row
        held = _joined(values, state, keyed, "inner").where(
            F.coalesce(F.col("_v") >= F.col("_lo"), F.lit(True)) & F.coalesce(F.col("_v") <= F.col("_hi"), F.lit(True)))
        ranked = (held.groupBy(*keyed, "_v").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"), F.max("_upto").alias("_upto"),
                                                 F.max("_lo").alias("_lo"))
                  # The rows at the lower end are among those up to it.
                  .withColumn("_c", F.when(F.col("_v") == F.col("_lo"), 0).otherwise(F.col("_c")))
                  .withColumn("_rank", F.col("_upto") + F.sum("_c").over(by_value)))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_rank") > rank, F.col("_v")))
    middle = ranked.groupBy(*keyed).agg(
        ((at(F.floor((F.col("_n") - 1) / 2)) + at(F.ceil((F.col("_n") - 1) / 2))) / 2).alias(name))
    if keys:
        return _joined(groups, middle, keys)
    return groups.withColumn(name, middle.select(name).scalar())
