"""As-of joins by union and window: one shuffle on the key, linear in both sides, never an inequality join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import next_weekday
from ..functions.windows import last_value

_SIDE = "__side"


def _merged(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, right_on: str, values: Sequence[str]) -> DataFrame:
    packed = right.select(*keys, F.col(right_on).alias(on), *(F.col(v).alias(f"__{v}") for v in values), F.lit(0).alias(_SIDE))
    return left.withColumn(_SIDE, F.lit(1)).unionByName(packed, allowMissingColumns=True)


def _order(on: str) -> list[Column]:
    return [F.col(on), F.col(_SIDE)]


def asof_columns(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, right_on: str, values: Sequence[str], marker: str | None = None) -> DataFrame:
    """Each value column gets its own last non-null value at or before the row's date; right rows come first on equal dates.

    marker names a column for the right date of the last row.
    """
    w = Window.partitionBy(*keys).orderBy(*_order(on))
    both = _merged(left, right, keys, on, right_on, values)
    out = {v: last_value(f"__{v}", w) for v in values}
    if marker:
        out[marker] = last_value(F.when(F.col(_SIDE) == 0, F.col(on)), w)
    return both.withColumns(out).where(F.col(_SIDE) == 1).drop(_SIDE, *(f"__{v}" for v in values))


def asof_row(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, right_on: str, values: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """All value columns of the last right row at or before the row's date, nulls included; tie orders rows of one date."""
    best = right.groupBy(*keys, right_on).agg(F.max_by(F.struct(*values), F.struct(*(tie or values))).alias("row"))
    w = Window.partitionBy(*keys).orderBy(*_order(on))
    both = _merged(left, best, keys, on, right_on, ["row"])
    return both.withColumn("__row", last_value("__row", w)).where(F.col(_SIDE) == 1).select(*left.columns, *(F.col(f"__row.{v}").alias(v) for v in values))


def asof_bounded(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, valid_from: str, valid_to: str, values: Sequence[str], default: object) -> DataFrame:
    """The interval that began last; past its end the default stands, not an older interval."""
    out = asof_row(left, right, keys, on, valid_from, [*values, valid_to])
    held = F.coalesce(F.col(on) <= F.col(valid_to), F.lit(True))
    found = {v: F.when(held & F.col(v).isNotNull(), F.col(v)).otherwise(F.lit(default)) for v in values}
    return out.withColumns(found).drop(valid_to)


def next_row(left: DataFrame, calendar: DataFrame, on: str, day: str, name: str, keys: Sequence[str] = (), weekdays_beyond: bool = False) -> DataFrame:
    """The first calendar day after the row's date, by key if there are keys.

    Only distinct dates are ordered, so even without keys the window holds no more rows than there are days. Beyond
    the calendar stands null, or the next weekday.
    """
    days = calendar.select(*keys, F.col(day).alias(on), F.col(day).alias("__day")).distinct()
    asked = left.select(*keys, on).distinct().withColumn("__day", F.lit(None).cast("date")).withColumn(_SIDE, F.lit(1))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col(on), F.col(_SIDE)).rowsBetween(1, Window.unboundedFollowing)
    both = asked.unionByName(days.withColumn(_SIDE, F.lit(0)))
    found = both.withColumn(name, F.first("__day", ignorenulls=True).over(w)).where(F.col(_SIDE) == 1).select(*keys, on, name)
    if weekdays_beyond:
        found = found.withColumn(name, F.coalesce(name, next_weekday(on)))
    return left.join(found, [*keys, on], "left").select(*left.columns, name)


def at_period_end(periods: DataFrame, prices: DataFrame, keys: Sequence[str], period_end: str, date: str, candidates: Sequence[str], name: str) -> DataFrame:
    """The last price at or before each period's end, from the first candidate column that the row has."""
    present = [c for c in candidates if c in prices.columns]
    priced = prices.select(*keys, date, F.coalesce(*present).alias(name))
    return asof_columns(periods, priced, keys, period_end, date, [name])
