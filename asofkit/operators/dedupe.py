"""One row per key, and upserts. Every choice has a total order, so results do not depend on the partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def latest_as_of(df: DataFrame, key: str, as_of: Column, available: str = "available_date", order: Sequence[str] = ("period_end", "filing_date", "available_date")) -> DataFrame:
    """Of what was known on a date, the last row by the order columns; a null there counts as last."""
    known = df.where(F.col(available) <= as_of)
    return first_per_key(known, [key], [F.col(c).desc_nulls_first() for c in order])


def completeness(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in cols))


def most_complete(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], ties: Sequence[Column | str]) -> DataFrame:
    """The row with the most values, then by ties."""
    return first_per_key(df, keys, [completeness(metrics).desc(), *ties])


def fill_from_earlier(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], order: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """The latest row's columns, each null filled from the latest earlier row that has a value."""
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in metrics), *(F.max_by(c, rank).alias(c) for c in carry))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not among the new, and all new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MERGE on the old table's schema: matched rows take the new values, others stay or are added."""
    rest = [c for c in old.columns if c not in keys]
    fresh = new.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(f"__{c}") if c in new.columns else F.lit(None).alias(f"__{c}") for c in rest), F.lit(True).alias("__hit"))
    both = old.join(fresh, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "full")
    take = lambda c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*(take(c) for c in old.columns))


def newest_batch(batches: DataFrame, keys: Sequence[str], batch: str) -> DataFrame:
    """Insert-or-replace: the row of the newest batch for each key; of several in one batch the one with the largest other columns."""
    rest = [c for c, t in batches.dtypes if c not in (*keys, batch) and not t.startswith("map")]
    return first_per_key(batches, keys, [F.col(c).desc() for c in (batch, *rest)])


def set_latest(df: DataFrame, key: str, date: str, column: str, value: Column) -> DataFrame:
    """Writes a column in the last row of each key only."""
    return df.withColumn(column, F.when(F.col(date) == F.max(date).over(Window.partitionBy(key)), value).otherwise(F.col(column)))


def keep_better(old: DataFrame, candidate: DataFrame, keys: Sequence[str], metrics: Sequence[str], near: float = 0.02) -> DataFrame:
    """Fills nulls, mends negative values where the candidate is not, and signs of values of nearly equal size."""
    right = candidate.select(*keys, *(F.col(m).alias(f"__{m}") for m in metrics))

    def choose(m: str) -> Column:
        a, b = F.col(m), F.col(f"__{m}")
        close = F.abs(F.abs(a) - F.abs(b)) <= near * F.greatest(F.abs(a), F.abs(b))
        return F.when(a.isNull(), b).when((a < 0) & (b >= 0), b).when((F.signum(a) * F.signum(b) < 0) & close, b).otherwise(a).alias(m)

    both = old.join(right, list(keys), "left")
    return both.select(*(choose(c) if c in metrics else F.col(c) for c in old.columns))


def by_priority(df: DataFrame, keys: Sequence[str], priorities: Sequence[str], order: str, value: str, additive: str) -> DataFrame:
    """Rows of the least priorities in turn; their first value by `order`, or their sum where `additive` holds."""
    best = df.withColumn("__r", F.rank().over(Window.partitionBy(*keys).orderBy(*priorities))).where("__r = 1")
    return best.groupBy(*keys).agg(F.when(F.bool_or(additive), F.sum(value)).otherwise(F.min_by(value, order)).alias(value))


def top_n(df: DataFrame, by: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def top_by_market_cap(prices: DataFrame, shares: DataFrame, n: int, most: float = 1e13, key: str = "ticker") -> DataFrame:
    """(key, market_cap, rank): the last close on the table's last date times the latest positive shares, sane ones only."""
    last = prices.select(F.max("date").alias("last"))
    close = prices.join(F.broadcast(last), F.col("date") == F.col("last"), "left_semi").select(key, "close")
    held = shares.where("shares > 0").groupBy(key).agg(F.max_by("shares", "period_end").alias("shares"))
    cap = close.join(held, key).select(key, (F.col("close") * F.col("shares")).alias("market_cap")).where((F.col("market_cap") > 0) & (F.col("market_cap") <= most))
    ranked = cap.orderBy(F.col("market_cap").desc(), key).limit(n)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("market_cap").desc(), key)))


def per_snapped_quarter(df: DataFrame, key: str, metrics: Sequence[str], latest: Sequence[str], days: int = 15) -> DataFrame:
    """One row per quarter end within so many days: the most complete, then the latest."""
    from ..functions.columns import snap_quarter_end

    snapped = df.withColumn("period_end", snap_quarter_end("period_end", days))
    return most_complete(snapped, [key, "period_end"], metrics, [F.col(c).desc_nulls_last() for c in latest])


def overlay(df: DataFrame, derived: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the columns that df lacks; none is written over."""
    fresh = [c for c in derived.columns if c not in df.columns]
    return df.join(derived.select(*keys, *fresh), list(keys), "left")


def united_maxima(relations: Sequence[DataFrame], key: str) -> DataFrame:
    """Relations with different columns as one row per key with each column's largest value."""
    both = relations[0]
    for r in relations[1:]:
        both = both.unionByName(r, allowMissingColumns=True)
    return both.groupBy(key).agg(*(F.max(c).alias(c) for c in both.columns if c != key))


def top_with_cascade(ranked: DataFrame, tables: dict[str, DataFrame], n: int, key: str = "ticker") -> dict[str, DataFrame]:
    """Every table cut to the keys of rank n or better."""
    kept = ranked.where(F.col("rank") <= n).select(key)
    return {name: keep_keys(df, kept, [key]) for name, df in tables.items()}


def left_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: Sequence[str], cols: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Columns of the first right row by order for each key; the null_safe keys match when both are null too."""
    every = [*keys, *null_safe]
    one = first_per_key(right, every, order).select(*(F.col(k).alias(f"__{k}") for k in every), *cols)
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in null_safe]
    return left.join(one, on, "left").select(*left.columns, *cols)


def pruned(tables: dict[str, DataFrame], keep: DataFrame, key: str = "ticker") -> dict[str, DataFrame]:
    """Every table without the rows whose key is not in the set."""
    return {name: keep_keys(df, keep, [key]) for name, df in tables.items()}


def merged_blocks(primary: DataFrame, supplement: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two blocks by label: the primary's values, else the supplement's; labels of both."""
    cols = [c for c in primary.columns if c not in keys]
    right = supplement.select(*keys, *(F.col(c).alias(f"__{c}") for c in cols))
    return primary.join(right, list(keys), "full").select(*keys, *(F.coalesce(c, f"__{c}").alias(c) for c in cols))
