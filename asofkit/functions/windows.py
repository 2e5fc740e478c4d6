"""Window expressions over ordered rows. Frames count rows, not days; nulls count as rows; minimum counts are of values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by(*keys: str, order: Sequence[str | Column] | str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def rows(w: WindowSpec, k: int) -> WindowSpec:
    """The row and the k - 1 before it."""
    return w.rowsBetween(1 - k, 0)


def strict(fn, c: str | Column, w: WindowSpec, k: int, least: int | None = None) -> Column:
    """fn over k rows where at least `least` of them (all, by default) have a value."""
    return F.when(F.count(c).over(rows(w, k)) >= (k if least is None else least), fn(c).over(rows(w, k)))


def ttm(c: str, w: WindowSpec, mode: str = "strict") -> Column:
    """Sum of four quarters. lenient: of what is there; strict: only of four values; partial: the mean value times four."""
    if mode == "lenient":
        return F.sum(c).over(rows(w, 4))
    if mode == "partial":
        return F.sum(c).over(rows(w, 4)) / F.count(c).over(rows(w, 4)) * 4
    return strict(F.sum, c, w, 4)


def lag_pct(c: str | Column, w: WindowSpec, k: int = 1) -> Column:
    before = F.lag(c, k).over(w)
    return F.when(before != 0, (F.col(c) if isinstance(c, str) else c) / before - 1)


def growth(c: str, w: WindowSpec, k: int, positive_base: bool = False) -> Column:
    """Percent over k rows before; with positive_base only from values above 0."""
    before = F.lag(c, k).over(w)
    return F.when(before > 0 if positive_base else before != 0, (F.col(c) / before - 1) * 100)


def growth_by_key(c: str, keys: Sequence[str], key: str, k: int) -> Column:
    """Percent over the row whose fiscal key is k less, whatever rows lie between."""
    before = F.last(c).over(Window.partitionBy(*keys).orderBy(key).rangeBetween(-k, -k))
    return F.when(before != 0, (F.col(c) / before - 1) * 100)


def momentum(c: str, w: WindowSpec, n: int, skip: int = 0) -> Column:
    recent = F.lag(c, skip).over(w) if skip else F.col(c)
    return F.when(F.lag(c, n).over(w) != 0, recent / F.lag(c, n).over(w) - 1)


def least_rows(n: int) -> int:
    return max(5, n // 4)


def sma(c: str, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return strict(F.avg, c, w, n, least_rows(n) if least is None else least)


def volatility(returns: str, w: WindowSpec, n: int) -> Column:
    """Annualised sample deviation of daily returns."""
    return strict(F.stddev_samp, returns, w, n, least_rows(n)) * math.sqrt(252)


def rsi(c: str, w: WindowSpec, n: int, change: str) -> Column:
    """From simple means of gains and losses, given the column of changes; null where nothing was lost."""
    # each frame function stands once, since Spark runs every one that it meets over the whole frame of each row
    gain, loss = (F.greatest(x, F.lit(0.0) * F.col(change)) for x in (F.col(change), -F.col(change)))
    up, down = (F.avg(x).over(rows(w, n)) for x in (gain, loss))
    return F.when(F.count(change).over(rows(w, n)) >= n, 100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))


def bollinger_z(c: str, w: WindowSpec, n: int = 20, least: int = 10) -> Column:
    mean, sd = (f(c).over(rows(w, n)) for f in (F.avg, F.stddev_samp))
    return F.when(F.count(c).over(rows(w, n)) >= least, (F.col(c) - mean) / (2 * F.nullif(sd, F.lit(0.0))))


def ichimoku(w: WindowSpec, n: int, high: str = "high", low: str = "low") -> Column:
    """Mid of the highest high and the lowest low of n rows."""
    return (strict(F.max, high, w, n) + strict(F.min, low, w, n)) / 2


def running_max(c: str, w: WindowSpec) -> Column:
    return F.max(c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(c: str, w: WindowSpec) -> Column:
    peak = running_max(c, w)
    return F.coalesce(F.when(peak != 0, F.col(c) / peak - 1), F.lit(0.0))


def running_product(c: Column, w: WindowSpec) -> Column:
    return F.product(c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def avg_rank(c: str, keys: Sequence[str], descending: bool = False) -> Column:
    """Rank with ties at their mean; nulls have none."""
    order = F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()
    return F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2)


def pct_rank(c: str, keys: Sequence[str]) -> Column:
    """Average rank over the number of values, 0 to 1."""
    return avg_rank(c, keys) / F.count(c).over(Window.partitionBy(*keys))


def zscore(c: str, keys: Sequence[str]) -> Column:
    """Against the sample deviation of the group; 0 where all are equal."""
    own = Window.partitionBy(*keys)
    sd = F.stddev_samp(c).over(own)
    return F.when(sd == 0, 0.0).otherwise((F.col(c) - F.avg(c).over(own)) / sd)


def last_value(c: str | Column, w: WindowSpec) -> Column:
    """The last value so far."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
