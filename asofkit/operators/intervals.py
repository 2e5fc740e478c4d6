"""Validity intervals, closed at both ends; a null end is open."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sweep

#: Actions that open and that close membership.
OPENS, CLOSES = ("add", "seed"), ("remove",)


def _end(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, sweep.forever())


def expand_events(events: DataFrame, ticker: str = "ticker", new: str = "ticker_new", action: str = "action") -> DataFrame:
    """Replace and rename become a remove of the old key and an add of the new one."""
    both = F.when(F.col(action).isin("replace", "rename"), F.array(F.struct(F.col(ticker).alias("t"), F.lit("remove").alias("a")), F.struct(F.col(new).alias("t"), F.lit("add").alias("a"))))
    steps = F.explode(F.coalesce(both, F.array(F.struct(F.col(ticker).alias("t"), F.col(action).alias("a")))))
    return events.withColumn("__s", steps).withColumns({ticker: F.col("__s.t"), action: F.col("__s.a")}).drop("__s")


def _ordered(events: DataFrame, keys: Sequence[str], date: str, action: str, ties: Sequence[str | Column]):
    rank = F.when(F.col(action).isin(*CLOSES), 0).otherwise(1)
    return events.where(F.col(date).isNotNull() & F.col(action).isin(*OPENS, *CLOSES)), Window.partitionBy(*keys).orderBy(date, rank, *ties)


def events_to_intervals(events: DataFrame, keys: Sequence[str], date: str = "date", action: str = "action", ties: Sequence[str | Column] = ("event_id",)) -> DataFrame:
    """(keys, valid_from, valid_to): each add opens, the next event of either kind closes the day before.

    Intervals that would end before they begin are left to event_issues().
    """
    rows, w = _ordered(events, keys, date, action, ties)
    opened = rows.withColumn("valid_to", F.date_sub(F.lead(date).over(w), 1)).where(F.col(action).isin(*OPENS))
    return opened.where(_end("valid_to") >= F.col(date)).select(*keys, F.col(date).alias("valid_from"), "valid_to")


def event_issues(events: DataFrame, keys: Sequence[str], date: str = "date", action: str = "action", ties: Sequence[str | Column] = ("event_id",)) -> DataFrame:
    """Removes with nothing open, and adds that would end before they begin."""
    rows, w = _ordered(events, keys, date, action, ties)
    rows = rows.withColumns({"__before": F.lag(action).over(w), "__next": F.lead(date).over(w)})
    issue = F.when(F.col(action).isin(*CLOSES) & F.coalesce(F.col("__before").isin(*CLOSES), F.lit(True)), "remove_without_add").when(F.col(action).isin(*OPENS) & (F.date_sub("__next", 1) < F.col(date)), "reversed")
    return rows.withColumn("issue", issue).where("issue IS NOT NULL").drop("__before", "__next")


def intervals_to_events(intervals: DataFrame, keys: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """An add per start and, where there is an end, a remove the day after."""
    pairs = F.array_compact(F.array(F.struct(F.col(start).alias("date"), F.lit("add").alias("action")), F.when(F.col(end).isNotNull(), F.struct(F.date_add(end, 1).alias("date"), F.lit("remove").alias("action")))))
    return intervals.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.date", "e.action")


def snapshots_to_events(snapshots: DataFrame, key: str, day: str) -> DataFrame:
    """(key, date, action) from daily member lists: all of the first day are added, then each day is compared with the one before."""
    days = snapshots.select(day).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(day)
    numbered = days.withColumns({"__n": F.row_number().over(w), "__next": F.lead(day).over(w)})
    own = snapshots.select(key, day).distinct().join(numbered, day)
    per_key = Window.partitionBy(key).orderBy("__n")
    own = own.withColumns({"__before": F.lag("__n").over(per_key), "__after": F.lead("__n").over(per_key)})
    added = own.where(F.col("__before").isNull() | (F.col("__before") < F.col("__n") - 1)).select(key, F.col(day).alias("date"), F.lit("add").alias("action"))
    removed = own.where(F.col("__next").isNotNull() & (F.col("__after").isNull() | (F.col("__after") > F.col("__n") + 1))).select(key, F.col("__next").alias("date"), F.lit("remove").alias("action"))
    return added.unionByName(removed)


def interval_asof(intervals: DataFrame, keys: Sequence[str], as_of: Column, order: Sequence[Column], start: str = "valid_from", end: str = "valid_to", least: Column | None = None) -> DataFrame:
    """One covering interval per key on a date: the latest start, then the given order; `least` filters by confidence."""
    rows = intervals.where((F.col(start) <= as_of) & (_end(end) >= as_of))
    rows = rows if least is None else rows.where(least)
    w = Window.partitionBy(*keys).orderBy(F.col(start).desc(), *order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def point_in_interval(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], order: Sequence[Column], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each row with the best interval of its key that covers its date, or nulls: the latest start, then `order` over the intervals' columns.

    A key's intervals become disjoint pieces in one ordered pass; rows look theirs up. Intervals without a key or start, or that end before they
    start, cover nothing; rows without a key or date find none. Rows may repeat.
    """
    return sweep.in_best(rows, intervals, keys, on, [F.col("__a").desc(), *order], values, start, end)


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_values: Sequence[str], b_values: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Pairs of intervals of one key that overlap, with what they have in common; a common open end is null. Intervals that end before they start overlap nothing."""
    both = sweep.overlapping(a, b, keys, a_values, b_values, start, end)
    return both.select(*keys, *a_values, *b_values, sweep.day_of(F.greatest("__a", "__from")).alias(start), F.nullif(sweep.day_of(F.least("__z", "__to")), sweep.forever()).alias(end))


def active(intervals: DataFrame, key: str, first: Column, last: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Keys with an interval that overlaps a period."""
    return intervals.where((F.col(start) <= last) & (_end(end) >= first)).select(key).distinct()


def membership_diff(intervals: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    """(key, change): added or removed between two dates."""
    both = intervals.groupBy(key).agg(F.bool_or((F.col("valid_from") <= before) & (_end("valid_to") >= before)).alias("a"), F.bool_or((F.col("valid_from") <= after) & (_end("valid_to") >= after)).alias("b"))
    return both.where("a <> b").select(key, F.when(F.col("b"), "added").otherwise("removed").alias("change"))


def merged(intervals: DataFrame, keys: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Overlapping and adjacent intervals of a key as one."""
    w = Window.partitionBy(*keys).orderBy(start, _end(end))
    reach = F.max(_end(end)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col(start) > F.date_add(F.least(reach, F.lit("9999-12-30").cast("date")), 1)), 1).otherwise(0)).over(w)
    return intervals.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min(start).alias(start), F.nullif(F.max(_end(end)), sweep.forever()).alias(end)).drop("__i")


def daily_counts(intervals: DataFrame, keys: Sequence[str], first: Column, last: Column) -> DataFrame:
    """(date, n): members on each weekday, from steps of +1 and -1 over merged intervals."""
    own = merged(intervals, keys)
    steps = F.array(F.struct(F.greatest("valid_from", first).alias("date"), F.lit(1).alias("step")), F.struct(F.date_add(F.least(_end("valid_to"), last), 1).alias("date"), F.lit(-1).alias("step")))
    inside = own.where((F.col("valid_from") <= last) & (_end("valid_to") >= first))
    steps = inside.select(F.explode(steps).alias("s")).groupBy(F.col("s.date").alias("date")).agg(F.sum("s.step").alias("step"))
    days = own.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("date"))
    total = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("date"))
    return days.join(steps, "date", "left").select("date", total.cast("long").alias("n")).where(F.weekday("date") < 5)


def overlaps(intervals: DataFrame, keys: Sequence[str], start: str = "valid_from", end: str = "valid_to", open_reaches: bool = True) -> DataFrame:
    """Intervals that begin at or before the end of an earlier one of their key; open_reaches counts open ends."""
    w = Window.partitionBy(*keys).orderBy(start, _end(end)).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(_end(end) if open_reaches else F.col(end)).over(w)
    return intervals.withColumn("reach", reach).where(F.col(start) <= F.col("reach")).drop("reach")


def with_overrides(base: DataFrame, overrides: DataFrame, keys: Sequence[str], value: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The base with overrides cut in: disjoint pieces, an override's value first, then the latest start, then the least value; equal neighbours joined again."""
    every = base.select(*keys, start, end, F.col(value).alias("v"), F.lit(1).alias("p")).unionByName(overrides.select(*keys, start, end, F.col(value).alias("v"), F.lit(0).alias("p")))
    best = sweep.best_pieces(every, keys, [F.col("p"), F.col("__a").desc(), F.col("v")], ["v", "p"], start, end)
    w = Window.partitionBy(*keys).orderBy("__from")
    change = F.when(F.lag("v").over(w).eqNullSafe(F.col("v")) & (F.lag("__to").over(w) + 1 == F.col("__from")), 0).otherwise(1)
    islands = best.withColumn("__c", change).withColumn("__i", F.sum("__c").over(w))
    joined = islands.groupBy(*keys, "__i", F.col("v").alias(value)).agg(F.min("__from").alias("__from"), F.max("__to").alias("__to"))
    return joined.select(*keys, value, sweep.day_of("__from").alias(start), F.nullif(sweep.day_of("__to"), sweep.forever()).alias(end))


def unified_memberships(exchanges: DataFrame, indexes: DataFrame) -> DataFrame:
    """(member, kind, code, valid_from, valid_to, source) of two shapes of membership rows.

    exchanges: (security_id, ticker, exchange, first_date, last_date); indexes: (index_code, ticker, company_id, start, end). A member is named by
    the first identifier that it has. Rows without one, without a start, or that end before it go; repeated rows count once.
    """
    named = lambda *cols: F.coalesce(*(F.concat(F.lit(f"{c}:"), F.nullif(F.upper(F.trim(F.col(c).cast("string"))), F.lit(""))) for c in cols))
    one = exchanges.select(named("security_id", "ticker").alias("member"), F.lit("exchange").alias("kind"), F.col("exchange").alias("code"), F.col("first_date").alias("valid_from"), F.col("last_date").alias("valid_to"), F.lit("exchanges").alias("source"))
    two = indexes.select(named("company_id", "ticker").alias("member"), F.lit("index").alias("kind"), F.col("index_code").alias("code"), F.col("start").alias("valid_from"), F.col("end").alias("valid_to"), F.lit("indexes").alias("source"))
    return one.unionByName(two).where(F.col("member").isNotNull() & F.col("valid_from").isNotNull() & (_end("valid_to") >= F.col("valid_from"))).distinct()


def issue_counts(issues: DataFrame, kind: str = "issue", severity: Mapping[str, str] | None = None) -> DataFrame:
    """(kind, severity, n)."""
    levels = F.create_map(*(F.lit(x) for p in (severity or {"": ""}).items() for x in p))
    return issues.groupBy(kind).agg(F.count("*").alias("n")).withColumn("severity", F.coalesce(levels[F.col(kind)], F.lit("warn")))
