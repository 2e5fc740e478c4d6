"""Profiles and audits of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sweep


def profile(df: DataFrame, keys: Sequence[str], date: str, cols: Sequence[str]) -> DataFrame:
    """Rows, date span and null rates by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(date).alias("first"), F.max(date).alias("last"), *(F.avg(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in cols))


def null_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, total, present, missing, rate): one pass over the table."""
    one = df.agg(F.count("*").alias("total"), *(F.count(c).alias(c) for c in cols))
    out = one.unpivot(["total"], list(cols), "column", "present")
    return out.select("column", "total", "present", (F.col("total") - F.col("present")).alias("missing"), F.when(F.col("total") > 0, 1 - F.col("present") / F.nullif(F.col("total"), F.lit(0))).alias("rate"))


def summary(df: DataFrame, relation: str, date: str, keys: Sequence[str], exact: bool = True) -> DataFrame:
    """One row for a table: rows, date span, null rates and distinct values of the keys."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(F.lit(relation).alias("relation"), F.count("*").alias("n"), F.min(date).alias("first"), F.max(date).alias("last"), *(F.avg(F.col(k).isNull().cast("int")).alias(f"null_{k}") for k in keys), *(distinct(k).alias(f"distinct_{k}") for k in keys))


def survey(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows share their key with an earlier one."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def fill_rates(df: DataFrame, keys: Sequence[str], method: str = "method") -> DataFrame:
    """Shares of rows with an availability date and of each family of methods."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), share(F.col("available_date").isNotNull()).alias("available"), share(F.col(method).startswith("fallback")).alias("fallback"), share(F.col(method).startswith("accepted")).alias("accepted"))


def quantiles(df: DataFrame, keys: Sequence[str], col: str, points: Sequence[float], positive: bool = True, exact: bool = True) -> DataFrame:
    """A column per point, by linear interpolation; exact=False reads them from a sketch of bounded size."""
    c = F.when(F.col(col) > 0, F.col(col)) if positive else F.col(col)
    fn = F.percentile if exact else F.percentile_approx
    own = df.groupBy(*keys).agg(fn(c, F.array(*map(F.lit, points))).alias("q"))
    return own.select(*keys, *(F.col("q")[k].alias(f"q{round(p * 100)}") for k, p in enumerate(points)))


def top_with_others(df: DataFrame, keys: Sequence[str], name: str, value: str, n: int) -> DataFrame:
    """The n largest by magnitude, and the sum of the others under that name if it is not 0."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.abs(value).desc(), name)
    group = F.when(F.row_number().over(w) <= n, F.col(name).cast("string")).otherwise("others")
    out = df.withColumn("__g", group).groupBy(*keys, F.col("__g").alias(name)).agg(F.sum(value).alias(value))
    return out.where((F.col(name) != "others") | (F.col(value) != 0))


def status(issues: Column, warnings: Column) -> Column:
    return F.when(issues > 0, "fail").when(warnings > 0, "warn").otherwise("pass")


def outside_validity(trades: DataFrame, intervals: DataFrame, key: str, date: str, row_key: str, warn_days: int, fail_days: int) -> DataFrame:
    """Each trade's distance in days to the nearest interval of its key and how many cover it, as pass, warn or fail; without a date or any interval: missing."""
    pieces = sweep.coverage_pieces(intervals, [key])
    near = sweep.in_pieces(trades.select(row_key, key, date), pieces, [key], date, ["covering", "last_end", "next_start"])
    at = sweep.day_number(F.col(date).cast("date"))
    days = F.when(F.col("covering") > 0, 0).otherwise(F.least(F.col("next_start") - at, at - F.col("last_end"))).cast("int")
    near = near.select(row_key, key, date, days.alias("days"), F.coalesce("covering", F.lit(0)).cast("long").alias("covering"))
    return near.withColumn("status", F.when(F.col("days").isNull(), "missing").when(F.col("days") <= warn_days, "pass").when(F.col("days") <= fail_days, "warn").otherwise("fail"))


def missing_rows(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that only one side has: `side` is expected or found."""
    a = expected.join(found, list(keys), "left_anti").select(*keys, F.lit("expected").alias("side"))
    return a.unionByName(found.join(expected, list(keys), "left_anti").select(*keys, F.lit("found").alias("side")))


def classification_audit(trades: DataFrame, intervals: DataFrame, key: str, date: str, value: str, by_cols: Sequence[str] = (), unclassified: Sequence[str] = ("unknown",)) -> DataFrame:
    """Per group: trades, and the rates without a covering interval, with an unclassified value, and with more than one value.

    Intervals meet the distinct dates of their key, not each trade.
    """
    days = trades.select(key, date).distinct()
    right = intervals.select(key, F.col("valid_from").alias("__a"), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("__z"), F.col(value).alias("__v"))
    found = days.join(right, key, "left").groupBy(key, date).agg(F.collect_set(F.when((F.col("__a") <= F.col(date)) & (F.col("__z") >= F.col(date)), F.col("__v"))).alias("__s"))
    rows = trades.join(found, [key, date])
    rate = lambda c: F.avg(c.cast("int"))
    odd = F.exists("__s", lambda v: v.isin(*unclassified))
    return rows.groupBy(*by_cols).agg(F.count("*").alias("n"), rate(F.size("__s") == 0).alias("missing_rate"), rate(odd).alias("unclassified_rate"), rate(F.size("__s") > 1).alias("conflict_rate"))


def event_statistics(events: DataFrame, *cols: str) -> DataFrame:
    """(dimension, value, n): counts of each column's values, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in cols)))
    return events.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def temporal_consistency(values: DataFrame, keys: Sequence[str], period: str, source: str) -> DataFrame:
    """Distinct periods and sources of each key."""
    return values.groupBy(*keys).agg(F.count_distinct(period).alias("periods"), F.count_distinct(source).alias("sources"))


def snapshot_audit(snapshots: DataFrame, log: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Per key: rows of the snapshots and of the log, required columns with nulls, and fail (only one side, or a count that differs), warn (nulls) or pass."""
    lacking = [c for c in required if c not in snapshots.columns]
    nulls = [F.max(F.col(c).isNull()).cast("int") for c in required if c not in lacking]
    own = snapshots.groupBy(*keys).agg(F.count("*").alias("n_snapshot"), (reduce(lambda a, b: a + b, nulls) if nulls else F.lit(0)).alias("columns_with_nulls"))
    both = own.join(log.groupBy(*keys).agg(F.count("*").alias("n_log")), list(keys), "full").fillna(0, ["n_snapshot", "n_log", "columns_with_nulls"])
    return both.withColumns({"missing_columns": F.lit(len(lacking)), "status": status((F.col("n_snapshot") != F.col("n_log")).cast("int") + len(lacking), F.col("columns_with_nulls"))})


def interval_quality(intervals: DataFrame, key: str, confidence: str, provenance: str) -> DataFrame:
    """Rates of low confidence, of missing provenance and of keys with several intervals; quantiles of confidence."""
    per_key = intervals.groupBy(key).agg(F.count("*").alias("n"))
    many = per_key.agg(F.avg((F.col("n") > 1).cast("int")).alias("multi_interval_rate"))
    own = intervals.agg(F.count("*").alias("n"), F.avg((F.col(confidence) < 0.5).cast("int")).alias("low_confidence_rate"), F.avg(F.col(provenance).isNull().cast("int")).alias("missing_provenance_rate"), F.min(confidence).alias("least"), F.max(confidence).alias("most"), F.avg(confidence).alias("mean"), F.percentile(confidence, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return own.join(many).select("n", "low_confidence_rate", "missing_provenance_rate", "multi_interval_rate", "least", "most", "mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90"))


def readiness(df: DataFrame, candidates: Sequence[str], key: str, period: str, other: DataFrame | None = None) -> DataFrame:
    """Per candidate column: rows, keys with values, dates, and the key-periods that another source has too; `ready`: half of the rows or more have a value."""
    long = df.select(key, period, *(F.col(c).cast("double").alias(c) for c in candidates)).unpivot([key, period], list(candidates), "candidate", "value")
    present = F.col("value").isNotNull()
    out = long.groupBy("candidate").agg(F.count("*").alias("n"), F.count("value").alias("present"), F.count_distinct(F.when(present, F.col(key))).alias("keys"), F.min(F.when(present, F.col(period))).alias("first"), F.max(F.when(present, F.col(period))).alias("last"))
    if other is not None:
        common = long.where(present).join(other.select(key, period).distinct(), [key, period], "left_semi").groupBy("candidate").agg(F.count("*").alias("overlap"))
        out = out.join(common, "candidate", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    return out.withColumn("ready", 2 * F.col("present") >= F.col("n"))
