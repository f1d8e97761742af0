"""Small Column helpers: null-safe clipping, guarded division, binning, rounding."""
from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scalar(one_row, column: str) -> Column:
    """A value of a one-row aggregate as an uncorrelated scalar subquery:
    computed once, no join; subqueries over the same aggregate are merged
    into one by the optimizer."""
    return one_row.select(column).scalar()


def clip(c, lo=None, hi=None) -> Column:
    """pandas ``clip``: bounds apply to non-null values, null stays null
    (``greatest``/``least`` alone would skip the null and return the bound)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, col(lo) if isinstance(lo, (str, Column)) else F.lit(lo))
    if hi is not None:
        out = F.least(out, col(hi) if isinstance(hi, (str, Column)) else F.lit(hi))
    return F.when(x.isNotNull(), out)


def safe_div(num, den) -> Column:
    """Division with a zero (or null) denominator giving null (ANSI-safe)."""
    return F.try_divide(col(num), col(den))


def right_closed_bins(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``pd.cut(x, edges, labels)``: label i covers (edges[i], edges[i+1]];
    values outside every bin (or null) give null."""
    x = col(c)
    expr = None
    for i, label in enumerate(labels):
        cond = (x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def first_match(rules: Iterable[tuple[Column, object]], default=None) -> Column:
    """``np.select``: the first true condition's value wins, else the default."""
    expr = None
    for cond, val in rules:
        v = val if isinstance(val, Column) else F.lit(val)
        c = F.coalesce(cond, F.lit(False))
        expr = F.when(c, v) if expr is None else expr.when(c, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(d) if expr is not None else d


def all_of(conds: Iterable[Column]) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def any_of(conds: Iterable[Column]) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def month_key(c) -> Column:
    """'YYYY-MM' month key."""
    return F.date_format(col(c), "yyyy-MM")


def null_safe_corr(x, y) -> Column:
    """Pearson correlation that yields null (not an error) for constant input:
    ``covar_samp / (stddev_samp * stddev_samp)`` with a guarded division,
    over rows where both values are present."""
    both = col(x).isNotNull() & col(y).isNotNull()
    xv = F.when(both, col(x).cast("double"))
    yv = F.when(both, col(y).cast("double"))
    return F.try_divide(F.covar_samp(xv, yv), F.stddev_samp(xv) * F.stddev_samp(yv))
