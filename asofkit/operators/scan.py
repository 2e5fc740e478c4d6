"""Recurrences along ordered rows, as a prefix scan in blocks.

A step is an affine map of the value before it, so the steps of a block compose to one map. A first pass finds each block's
map, a fold over a key's few maps finds what enters each block, and a second pass runs every block from there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAP = "struct<first:double,lead:int,a:double,b:double,gap:int>"
_STATE = "struct<y:double,gap:int>"


def _blend(before: Column, gap: Column, x: Column, span: int) -> Column:
    """The mean after x, `gap` rows without a value after the one that gave `before`."""
    alpha = 2 / (span + 1)
    weight = F.pow(F.lit(1 - alpha), gap + 1)
    return (weight * before + alpha * x) / (weight + alpha)


def _block_map(values: Column, span: int) -> Column:
    """first: the block's first value, after `lead` rows without one; a, b: from the mean there to the last one; gap: rows after the last value."""

    def step(acc: Column, v: Column) -> Column:
        x, seen = v["x"], acc["first"].isNotNull()
        one, none = F.lit(1.0), F.lit(0.0)
        empty = F.struct(acc["first"], F.when(seen, acc["lead"]).otherwise(acc["lead"] + 1), acc["a"], acc["b"], F.when(seen, acc["gap"] + 1).otherwise(acc["gap"]))
        started = F.struct(x, acc["lead"], one, none, F.lit(0))
        # the map's slope is the step from a to a without a value, its shift the step from b
        further = F.struct(acc["first"], acc["lead"], _blend(acc["a"], acc["gap"], none, span), _blend(acc["b"], acc["gap"], x, span), F.lit(0))
        return F.when(x.isNull(), empty.cast(_MAP)).when(seen, further.cast(_MAP)).otherwise(started.cast(_MAP))

    start = F.struct(F.lit(None).cast("double"), F.lit(0), F.lit(1.0), F.lit(0.0), F.lit(0)).cast(_MAP)
    return F.aggregate(values, start, step)


def _entering(maps: Column, name: str, span: int) -> Column:
    """For each block of a key, in order, its bin and the state that enters it."""

    def step(acc: Column, block: Column) -> Column:
        m, y, gap = block[name], acc["now"]["y"], acc["now"]["gap"]
        first = F.when(y.isNull(), m["first"]).otherwise(_blend(y, gap + m["lead"], m["first"], span))
        after = F.when(m["first"].isNull(), F.struct(y, gap + m["lead"]).cast(_STATE)).otherwise(F.struct(m["a"] * first + m["b"], m["gap"]).cast(_STATE))
        return F.struct(after.alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))

    start = F.struct(F.struct(F.lit(None).cast("double"), F.lit(0)).cast(_STATE).alias("now"), F.array().cast(f"array<{_STATE}>").alias("out"))
    return F.aggregate(maps, start, step, lambda acc: acc["out"])


def _means(values: Column, state: Column, span: int) -> Column:
    """The means at a block's rows, from the state that enters it."""

    def step(acc: Column, v: Column) -> Column:
        x, y, gap = v["x"], acc["now"]["y"], acc["now"]["gap"]
        mean = F.when(x.isNull(), y).when(y.isNull(), x).otherwise(_blend(y, gap, x, span))
        now = F.struct(mean, F.when(x.isNull(), gap + 1).otherwise(0)).cast(_STATE)
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(mean)).alias("out"))

    start = F.struct(state.cast(_STATE).alias("now"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def exponential_means(df: DataFrame, keys: Sequence[str], value: str, spans: Mapping[str, int], date: str = "date", days: int = 64) -> DataFrame:
    """(keys, date, value, a column for each of `spans`): exponential means with weight 2 / (span + 1), seeded by a key's first value.

    A row without a value repeats the mean before it, and older values lose weight with it; before the first value the mean is null.
    Rows of one key and date count in the order of their values, nulls first; rows without a date come before all others; a null
    key is a key of its own. A block is what a key has within `days` days, so a long history is split over tasks; the maps of one
    key's blocks are folded together, one row of five numbers each.
    """
    bin_of = F.coalesce(F.floor(F.unix_date(F.col(date).cast("date")) / days).cast("int"), F.lit(-(1 << 31)))
    rows = df.select(*keys, bin_of.alias("__bin"), F.struct(F.col(date).alias("d"), F.col(value).cast("double").alias("x")).alias("__v"))
    blocks = rows.groupBy(*keys, "__bin").agg(F.sort_array(F.collect_list("__v")).alias("__v"))
    maps = blocks.select(*keys, F.struct(F.col("__bin").alias("bin"), *(_block_map(F.col("__v"), span).alias(name) for name, span in spans.items())).alias("__m"))
    histories = maps.groupBy(*(F.col(k).alias(f"__k_{k}") for k in keys)).agg(F.sort_array(F.collect_list("__m")).alias("__m"))
    states = F.arrays_zip(F.col("__m.bin").alias("bin"), *(_entering(F.col("__m"), name, span).alias(name) for name, span in spans.items()))
    carried = histories.select(*(f"__k_{k}" for k in keys), F.explode(states).alias("__s"))
    same = F.col("__bin") == F.col("__s.bin")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    means = (_means(F.col("__v"), F.col(f"__s.{name}"), span).alias(name) for name, span in spans.items())
    whole = blocks.join(carried, same).select(*keys, F.explode(F.arrays_zip(F.col("__v.d").alias("d"), F.col("__v.x").alias("x"), *means)).alias("__r"))
    return whole.select(*keys, F.col("__r.d").alias(date), F.col("__r.x").alias(value), *(F.col(f"__r.{name}").alias(name) for name in spans))
