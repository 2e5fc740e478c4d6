"""Cross-sections: rules, universe filters, scores, ranks and weights. Every window is partitioned by date, so all dates run at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import decided, size_bucket
from ..functions.windows import avg_rank, pct_rank


def rule(text: str | None) -> Column:
    """A Boolean SQL expression over columns; an empty one passes all."""
    return decided(F.expr(text)) if text and text.strip() else F.lit(True)


def with_conditions(df: DataFrame, clauses: Mapping[str, str], formula: str | None = None, on_null: str = "fail") -> DataFrame:
    """Adds a Boolean column per label, `selected`, and the labels that passed and that failed."""
    out = df.withColumns({k: decided(F.expr(c), on_null) for k, c in clauses.items()})
    mask = F.expr(formula) if formula else reduce(lambda a, b: a & b, map(F.col, clauses))
    marks = F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("ok")) for k in clauses))
    names = lambda ok: F.transform(F.filter(marks, lambda m: m["ok"] == ok), lambda m: m["name"])
    return out.withColumns({"selected": mask, "passed": names(F.lit(True)), "failed": names(F.lit(False))})


def masks(buy: str, sell: str | None = None) -> tuple[Column, Column]:
    """Buy and sell; without a sell rule, what is not bought is sold."""
    return rule(buy), (rule(sell) if sell and sell.strip() else ~rule(buy))


def grouped_filters(first: Sequence[Column], second: Sequence[Column]) -> Column:
    """Either all of the first or all of the second; an empty group does not count."""
    groups = [reduce(lambda a, b: a & b, g) for g in (first, second) if g]
    return reduce(lambda a, b: a | b, groups) if groups else F.lit(True)


def universe(df: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, where: str | None = None, least_cap: float | None = None, least_dollar_volume: float | None = None, least_price: float | None = None, buckets: Sequence[str] = (), sectors: Sequence[str] = (), not_sectors: Sequence[str] = (), financials: DataFrame | None = None, key: str = "ticker") -> DataFrame:
    """The stack of universe filters; lists are DataFrames of keys."""
    out = df.where(rule(where))
    for name, least in (("market_cap", least_cap), ("dollar_volume", least_dollar_volume), ("close", least_price)):
        out = out if least is None else out.where(F.col(name) >= least)
    if buckets:
        out = out.where(size_bucket("market_cap").isin(*buckets))
    if sectors:
        out = out.where(F.col("sector").isin(*sectors))
    if not_sectors:
        out = out.where(~F.coalesce(F.col("sector").isin(*not_sectors), F.lit(False)))
    for other, how in ((include, "left_semi"), (financials, "left_semi"), (exclude, "left_anti")):
        out = out if other is None else out.join(other.select(key).distinct(), key, how)
    return out


def winsorised(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Columns clipped to quantiles of their group; the quantiles come back by a join on the group."""
    bounds = df.groupBy(*keys).agg(*(F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"__{c}") for c in cols))
    out = df.join(bounds, list(keys))
    clip = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"__{c}")[0]), F.col(f"__{c}")[1]))
    return out.withColumns({c: clip(c) for c in cols}).drop(*(f"__{c}" for c in cols))


def scored(df: DataFrame, factors: Mapping[str, tuple[float, bool]], keys: Sequence[str] = ("date",)) -> DataFrame:
    """score: the mean of the factors' percentile scores by weight, over those that the row has. factors: name -> (weight, higher is better)."""
    parts = {}
    for c, (_, up) in factors.items():
        parts[f"__{c}"] = pct_rank(c, keys) * 100 if up else (1 - pct_rank(c, keys)) * 100
    out = df.withColumns(parts)
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"__{c}") * w, F.lit(0.0)) for c, (w, _) in factors.items()))
    weight = reduce(lambda a, b: a + b, (F.when(F.col(f"__{c}").isNotNull(), w).otherwise(0.0) for c, (w, _) in factors.items()))
    return out.withColumn("score", F.when(weight > 0, total / weight)).drop(*parts)


def ranked(df: DataFrame, score: str = "score", keys: Sequence[str] = ("date",), tie: str = "ticker") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), tie)
    return df.withColumn("rank", F.row_number().over(w))


def weighted(df: DataFrame, by_score: bool = False, cap: float = 1.0, score: str = "score", keys: Sequence[str] = ("date",)) -> DataFrame:
    """weight: equal, or in proportion to the score (below 0 counts as 0; equal where all are 0); capped, and scaled down only if the sum is above 1."""
    own = Window.partitionBy(*keys)
    equal = 1 / F.count(F.lit(1)).over(own)
    if by_score:
        part = F.greatest(F.coalesce(F.col(score), F.lit(0.0)), F.lit(0.0))
        total = F.sum(part).over(own)
        raw = F.when(total > 0, part / F.nullif(total, F.lit(0.0))).otherwise(equal)
    else:
        raw = equal
    out = df.withColumn("__w", F.least(raw, F.lit(cap)))
    total = F.sum("__w").over(own)
    return out.withColumn("weight", F.when(total > 1, F.col("__w") / total).otherwise(F.col("__w"))).drop("__w")


def rebalance_dates(calendar: DataFrame, every: str, day: str = "date") -> DataFrame:
    """The last trading day of each week (to Sunday), month, quarter or year."""
    return calendar.groupBy(F.date_trunc(every, day).alias("period")).agg(F.max(day).alias(day)).select(day)


def execution_days(signals: DataFrame, calendar: DataFrame, shift: int = 1, day: str = "date") -> DataFrame:
    """(signal_date, exec_date): so many trading days later, at most the last one. The calendar is one row per trading day."""
    w = Window.partitionBy(F.lit(0)).orderBy(day)
    days = calendar.select(day).distinct().withColumn("__n", F.row_number().over(w))
    last = days.agg(F.max("__n").alias("__last"))
    target = days.select(F.col(day).alias("exec_date"), F.col("__n").alias("__t"))
    at = signals.select(day).distinct().join(days, day).crossJoin(F.broadcast(last)).withColumn("__t", F.least(F.col("__n") + shift, F.col("__last")))
    return at.join(target, "__t").select(F.col(day).alias("signal_date"), "exec_date")


def target_periods(df: DataFrame, pairs: Sequence[tuple[int, int]], year: str = "fiscal_year", quarter: str = "fiscal_quarter") -> DataFrame:
    """Rows of a list of (year, quarter) pairs."""
    wanted = df.sparkSession.createDataFrame(sorted(set(pairs)), f"{year} int, {quarter} int")
    return df.join(wanted, [year, quarter], "left_semi")


def without_look_ahead(df: DataFrame, signal: str, as_of: Sequence[str]) -> DataFrame:
    """Adds look_ahead_ok: no as-of date lies after the signal date."""
    return df.withColumn("look_ahead_ok", reduce(lambda a, b: a & b, (F.coalesce(F.col(c) <= F.col(signal), F.lit(True)) for c in as_of)))


def rank_columns(df: DataFrame, c: str, keys: Sequence[str] = ("date",)) -> DataFrame:
    from ..functions.windows import zscore

    return df.withColumns({"rank_asc": avg_rank(c, keys), "rank_desc": avg_rank(c, keys, True), "pct": pct_rank(c, keys), "z": zscore(c, keys)})


def within_validity(panel: DataFrame, overrides: DataFrame | None = None, key: str = "ticker", date: str = "date") -> DataFrame:
    """Rows between a key's first and last valid day: an override's bounds, else the observed ones."""
    seen = panel.groupBy(key).agg(F.min(date).alias("__a"), F.max(date).alias("__z"))
    if overrides is not None:
        seen = seen.join(overrides.select(key, "first_valid", "last_valid"), key, "left").select(key, F.coalesce("first_valid", "__a").alias("__a"), F.coalesce("last_valid", "__z").alias("__z"))
    return panel.join(seen, key).where(F.col(date).between(F.col("__a"), F.col("__z"))).drop("__a", "__z")


def members_only(panel: DataFrame, intervals: DataFrame, evidence: Sequence[str] = (), key: str = "ticker", date: str = "date") -> DataFrame:
    """The cross-sections' members with the columns that prove it; dates and keys join, bounds filter."""
    right = intervals.select(key, F.col("valid_from").alias("__a"), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("__z"), *evidence)
    both = panel.join(right, key).where((F.col(date) >= F.col("__a")) & (F.col(date) <= F.col("__z")))
    w = Window.partitionBy(key, date).orderBy(F.col("__a").desc(), "__z")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__a", "__z")
