"""Ranks of values over all rows, and their lookup without a shuffle of the rows.

``counts_below`` sorts the distinct values once by range: each partition sums its counts,
the sums of the partitions before (a few numbers per partition) are its offset, and inside
a partition a running sum completes the rank. No task sees all values of a column.

``look_up`` brings ranks to the rows. Columns with at most ``SHARED`` distinct values, and
of the others every value that at least one row in ``SHARED`` has, fit in one small table
with a proven bound; it is broadcast once and read once per column. Only the rare values
of a column with very many need a join by value, where no value is frequent any more; the
rows that are already served are spread by a salt.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

SHARED = 20_000


def counts_below(counts: DataFrame, group: str, value: str, numbers: list[str]) -> DataFrame:
    """``counts`` (one row per ``group`` and ``value``), stored, with ``below_<n>`` for every
    column n of ``numbers``: its sum over the group's smaller values."""
    placed = stored(counts.repartitionByRange(group, value).withColumn("_part", F.spark_partition_id()), "by_value")
    before_part = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part", group).agg(*[F.sum(n).alias(n) for n in numbers])
               .select("_part", group, *[F.coalesce(F.sum(n).over(before_part), F.lit(0)).alias(f"_before_{n}") for n in numbers]))
    inside = Window.partitionBy("_part", group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(offsets, ["_part", group])
            .select(*counts.columns, *[(F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_before_{n}")).alias(f"below_{n}") for n in numbers]))


def look_up(rows: DataFrame, columns: list[str], ranks: DataFrame, names: list[str], frequency: str,
            sizes: dict[int, tuple[int, int]], shared: int = SHARED) -> DataFrame:
    """``rows`` with ``<name>_<column>`` for every column and name: the value of ``names`` in
    ``ranks`` (stored: col, the column's place in ``columns``; v; names; ``frequency``, the
    number of rows with that value), null for a null value. ``sizes``: place -> (distinct
    values, rows with a value)."""
    wide = [i for i in range(len(columns)) if sizes.get(i, (0, 0))[0] > shared]
    common = ranks
    if wide:
        often = reduce(lambda a, b: a | b, [(F.col("col") == i) & (F.col(frequency) * shared >= sizes[i][1]) for i in wide])
        common = ranks.where(~F.col("col").isin(wide) | often)
    table = F.broadcast(common.select("col", "v", *names))  # at most ``shared`` rows per column
    out = rows.alias("rows")
    for i, c in enumerate(columns):
        out = out.join(table.alias(f"t{i}"), F.expr(f"t{i}.col = {i} AND CAST(rows.`{c}` AS DOUBLE) = t{i}.v"), "left")
    out = out.selectExpr("rows.*", *[f"t{i}.`{n}` AS `{n}_{c}`" for i, c in enumerate(columns) for n in names])
    for i in wide:
        c = columns[i]
        rare = ranks.where((F.col("col") == i) & ~(F.col(frequency) * shared >= sizes[i][1])).selectExpr(
            "v AS _v", "-1L AS _s", *[f"`{n}` AS `_{n}`" for n in names])
        salted = out.selectExpr("*", f"CAST(`{c}` AS DOUBLE) AS _key", f"CASE WHEN `{names[0]}_{c}` IS NULL AND `{c}` IS NOT NULL THEN -1L "
                                "ELSE monotonically_increasing_id() % 1000 END AS _salt")
        own = {f"{n}_{c}": f"coalesce(`{n}_{c}`, `_{n}`) AS `{n}_{c}`" for n in names}
        out = salted.join(rare, F.expr("_key = _v AND _salt = _s"), "left").selectExpr(*[own.get(x, f"`{x}`") for x in out.columns])
    return out
