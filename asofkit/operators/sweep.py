"""Covering and overlap without range joins.

A key's overlapping intervals become disjoint pieces in one ordered pass; rows look up their day in them by key and bin of days,
and overlaps meet by key and bin of bounds. Where codes meet ranges: any run of whole numbers is the union of few aligned blocks of
1, 2, 4, ..., and a number lies in one block of each size, so that covering is an equality of block numbers, which Spark hashes.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.windows import last_value

#: Stands for an open end in comparisons.
FOREVER = "9999-12-31"
#: Days are counted from 0001-01-01 on.
_DAY_0 = -719162
#: Days in a bin of rows; a hot key is split into its bins.
BIN_DAYS = 128
#: Bounds in a bin of intervals; a hot key is split into its bins.
BIN_POINTS = 64
#: Bins in a mask, which tells in which of them a key has rows.
_MASK_BINS = 32


def forever() -> Column:
    return F.lit(FOREVER).cast("date")


def day_number(day: str | Column) -> Column:
    return (F.unix_date(day) - _DAY_0).cast("long")


def day_of(number: str | Column) -> Column:
    return F.date_from_unix_date((F.col(number) if isinstance(number, str) else number).cast("int") + _DAY_0)


def cover(first: str, last: str, bits: str) -> Column:
    """The blocks that make up the whole numbers from first to last (SQL), 0 <= first <= 2**bits; none where last < first. At most two of each size."""
    low, high = f"shiftright({first} + shiftleft(1L, k) - 1, k)", f"shiftright({last} + 1, k)"
    both = f"array(if({low} < {high} AND {low} % 2 = 1, shiftleft(CAST(k AS BIGINT), 40) + {low}, NULL), if({low} < {high} AND {high} % 2 = 1, shiftleft(CAST(k AS BIGINT), 40) + {high} - 1, NULL))"
    return F.array_compact(F.expr(f"flatten(transform(sequence(0, {bits}), k -> {both}))"))


def blocks_of(number: str, bits: str) -> Column:
    """The block of each size that a whole number lies in; exactly one of them is in each cover() that holds the number."""
    return F.expr(f"transform(sequence(0, {bits}), k -> shiftleft(CAST(k AS BIGINT), 40) + shiftright({number}, k))")


def _spans(intervals: DataFrame, keys: Sequence[str], values: Sequence[str] | None, start: str, end: str) -> DataFrame:
    """(keys, __a, __z, values, or all columns): days as numbers; intervals without key or start, and those that end before they start, go."""
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, start)))
    own = ["*"] if values is None else [*keys, *values]
    rows = intervals.where(whole).select(*own, day_number(start).alias("__a"), day_number(F.coalesce(F.col(end), forever())).alias("__z"))
    return rows.where("__a <= __z")


def _numbered(rows: DataFrame, keys: Sequence[str], first: str, last: str) -> DataFrame:
    """The rows with the numbers __p and __q of two of their columns among the points of their key, from one shuffle and sort by key.

    The two points of a row leave one task together, so the row's id holds them together.
    """
    own = F.struct(*(c for c in rows.columns if c not in keys)).alias("__row")
    packed = rows.select(*keys, F.monotonically_increasing_id().alias("__id"), own)
    ends = F.array(F.struct(F.col(f"__row.{first}").alias("at"), F.col("__row").alias("row")), F.struct(F.col(f"__row.{last}").alias("at"), F.lit(None).cast(packed.schema["__row"].dataType).alias("row")))
    points = packed.select(*keys, "__id", F.explode(ends).alias("e")).select(*keys, "__id", "e.row", F.col("e.at").alias("__at"))
    points = points.withColumn("__p", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("__at")) - 1).cast("long"))
    whole = points.groupBy(*keys, "__id").agg(F.min("__p").alias("__p"), F.max("__p").alias("__q"), F.first("row", ignorenulls=True).alias("__row"))
    return whole.select(*keys, "__p", "__q", "__row.*")


def best_pieces(intervals: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str], start: str = "valid_from", end: str = "valid_to", asked: DataFrame | None = None) -> DataFrame:
    """(keys, __from, __to, values): disjoint pieces of each key's days, each with the values of the interval that comes first in `order`.

    `order` may name the intervals' columns, and `__a`, the interval's first day as a number. With `asked` (keys, __bin) only the pieces that
    meet these bins of BIN_DAYS come, cut where their bin begins and with its __bin. The intervals are shuffled and sorted by key once; then an
    ordered pass over their starts holds those that may still come first. One that ends no later than a better one is dropped, so
    at most one is held for each end, however many overlap.
    """
    rows = _spans(intervals, keys, None, start, end)
    if asked is not None:
        chunk = F.floor(F.col("__bin") / _MASK_BINS).cast("long").alias("__chunk")
        masks = asked.groupBy(*keys, chunk).agg(F.expr(f"bit_or(shiftleft(1L, CAST(pmod(__bin, {_MASK_BINS}) AS INT)))").alias("__mask"))
        rows = rows.unionByName(masks.select(*keys, (F.col("__chunk") * (_MASK_BINS * BIN_DAYS)).alias("__a"), "__mask"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.repartition(*keys).withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumns({"__rank": F.row_number().over(w), "__key": F.first("__id").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    if asked is not None:
        bits = F.expr(f"if(__mask IS NULL, array(0), filter(sequence(0, {_MASK_BINS - 1}), i -> shiftright(__mask, i) % 2 = 1))")
        rows = rows.withColumn("__bit", F.explode(bits)).withColumn("__a", F.col("__a") + F.col("__bit") * BIN_DAYS)
    rows = rows.select("__key", "__rank", "__a", "__z", *keys, *values).sortWithinPartitions("__key", "__a")
    return _first_by_day(rows, keys, values, asked is not None)


def _first_by_day(rows: DataFrame, keys: Sequence[str], values: Sequence[str], binned: bool) -> DataFrame:
    """The ordered pass of best_pieces(). A row without __z is a bin that begins on its day; values are taken from their batch as they are."""
    long = lambda *names: [StructField(n, LongType()) for n in names]
    kinds = StructType([*(rows.schema[k] for k in keys), *long("__bin", "__from", "__to")[not binned :], *(rows.schema[v] for v in values)])
    names, width, never = kinds.names, BIN_DAYS, 1 << 40

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # those that may still come first, the best at the end, where ends are earliest; `at` are their rows in the pool
        ranks, ends, at = [], [], []
        pool, own, day, low, high, found = None, None, 0, -never, never, []

        def pieces(stop: int) -> None:
            """The pieces from `day` to before stop."""
            nonlocal day
            while ends and day < stop:
                last = min(ends[-1], stop - 1)
                if day <= high and last >= low:
                    first = max(day, low)
                    if found and found[-1][0] == at[-1] and found[-1][1] == low and found[-1][2] + 1 == first:
                        found[-1][2] = last
                    else:
                        found.append([at[-1], low, last, first])
                day = last + 1
                if ends[-1] < day:
                    del ranks[-1], ends[-1], at[-1]
            day = stop

        def batch() -> pa.RecordBatch:
            index, bins, lasts, firsts = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
            cut = [pa.array([x // width for x in bins.to_pylist()], pa.int64())] if binned else []
            taken = pool.take(index)
            found.clear()
            return pa.RecordBatch.from_arrays([*taken.columns[: len(keys)], *cut, firsts, lasts, *taken.columns[len(keys) :]], names=names)

        for part in batches:
            held = len(at)
            own_columns = pa.RecordBatch.from_arrays(part.columns[4:], names=part.schema.names[4:])
            pool = pa.concat_batches([pool, own_columns]) if held else own_columns
            for n, (key, rank, a, z) in enumerate(zip(*(c.to_pylist() for c in part.columns[:4]), strict=True), held):
                if key != own:
                    pieces(never)
                    own, day = key, a
                    low, high = (never, -never) if binned else (-never, never)
                pieces(a)
                if z is None:
                    low, high = a, a + width - 1
                    continue
                i = bisect(ranks, -rank)
                if i < len(ends) and ends[i] >= z:
                    continue
                k = i
                while k and ends[k - 1] <= z:
                    k -= 1
                ranks[k:i], ends[k:i], at[k:i] = [-rank], [z], [n]
            if found:
                yield batch()
            pool, at = pool.take(pa.array(at, pa.int64())), list(range(len(at)))
        pieces(never)
        if found:
            yield batch()

    return rows.mapInArrow(run, kinds)


def coverage_pieces(intervals: DataFrame, keys: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(keys, __from, __to, covering, last_end, next_start): all days of each key, with the number of intervals that cover them.

    last_end is the latest end of those that started before, next_start the start of the next; both are day numbers.
    """
    rows = _spans(intervals, keys, (), start, end)
    step = lambda at, n, a, z: F.struct(at.alias("__from"), F.lit(n).alias("step"), a.alias("a"), z.alias("z"))
    none = F.lit(None).cast("long")
    steps = F.array(step(F.col("__a"), 1, F.col("__a"), F.col("__z")), step(F.col("__z") + 1, -1, none, none), step(F.lit(0).cast("long"), 0, none, none))
    bounds = rows.select(*keys, F.explode(steps).alias("s")).groupBy(*keys, F.col("s.__from").alias("__from")).agg(F.sum("s.step").alias("step"), F.max("s.a").alias("a"), F.max("s.z").alias("z"))
    w = Window.partitionBy(*keys).orderBy("__from")
    back = Window.partitionBy(*keys).orderBy(F.col("__from").desc())
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, -1)
    return bounds.select(
        *keys, "__from", F.coalesce(F.lead("__from").over(w) - 1, day_number(forever())).alias("__to"), F.sum("step").over(upto).alias("covering"),
        F.max("z").over(upto).alias("last_end"), F.last("a", ignorenulls=True).over(before).alias("next_start"),
    )


def _bin_of(day: str) -> Column:
    return F.floor(F.col(day) / BIN_DAYS).cast("long")


def in_pieces(rows: DataFrame, pieces: DataFrame, keys: Sequence[str], on: str, values: Sequence[str]) -> DataFrame:
    """Each row with the values of its key's piece that holds its day, or nulls; rows without key or day find none.

    Pieces are cut at the bins in which their key has rows, so that no key has to fit one task.
    """
    span = _asked(rows, on).where("__bin IS NOT NULL").groupBy(*keys).agg(F.min("__bin").alias("__low"), F.max("__bin").alias("__high"))
    near = pieces.join(span, list(keys)).withColumns({"__b": F.greatest(_bin_of("__from"), "__low"), "__e": F.least(_bin_of("__to"), "__high")})
    cut = near.withColumn("__bin", F.explode(F.when(F.col("__b") <= F.col("__e"), F.sequence("__b", "__e"))))
    return _in_cut(rows, cut.withColumn("__from", F.greatest(F.col("__from"), F.col("__bin") * BIN_DAYS)), keys, on, values)


def in_best(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], on: str, order: Sequence[Column], values: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """in_pieces() of best_pieces(), which come cut from their pass: the pieces are shuffled once, and only those that have rows in their bin."""
    asked = _asked(rows, on).where("__bin IS NOT NULL").select(*keys, "__bin")
    return _in_cut(rows, best_pieces(intervals, keys, order, values, start, end, asked), keys, on, values)


def _asked(rows: DataFrame, on: str) -> DataFrame:
    return rows.withColumns({"__at": day_number(F.col(on).cast("date")), "__side": F.lit(1)}).withColumn("__bin", _bin_of("__at"))


def _in_cut(rows: DataFrame, cut: DataFrame, keys: Sequence[str], on: str, values: Sequence[str]) -> DataFrame:
    """A union and a window by key and bin find the last piece (keys, __bin, __from, __to, values) that starts at or before each row."""
    found = F.struct(F.col("__to"), *(F.col(v).alias(f"v{k}") for k, v in enumerate(values)))
    cut = cut.select(*keys, "__bin", F.col("__from").alias("__at"), F.lit(0).alias("__side"), found.alias("__found"))
    w = Window.partitionBy(*keys, "__bin").orderBy("__at", "__side")
    both = _asked(rows, on).unionByName(cut, allowMissingColumns=True).withColumn("__found", last_value("__found", w)).where("__side = 1")
    held = F.when(F.col("__found.__to") >= F.col("__at"), F.col("__found"))
    return both.withColumn("__found", held).select(*rows.columns, *(F.col(f"__found.v{k}").alias(v) for k, v in enumerate(values)))


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], a_values: Sequence[str], b_values: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(keys, a_values, b_values, __a, __z, __from, __to): every pair of intervals of one key with a common day, once.

    Intervals meet in bins of BIN_POINTS of their key's bounds, and a pair counts in the first bin that both touch. Two that meet
    in a bin and do not overlap both have a bound in it, so they are few for each bound; a key with many intervals has many bins.
    """
    left = _spans(a, keys, a_values, start, end).select(*keys, "__a", "__z", F.struct(*a_values, F.lit(0)).alias("__left"))
    right = _spans(b, keys, b_values, start, end).select(*keys, "__a", "__z", F.struct(*b_values, F.lit(0)).alias("__right"))
    both = _numbered(left.unionByName(right, allowMissingColumns=True), keys, "__a", "__z")
    bin_of = lambda c: F.floor(F.col(c) / BIN_POINTS)
    both = both.withColumn("__bin", F.explode(F.sequence(bin_of("__p"), bin_of("__q"))))
    own = lambda side, values: (F.col(f"{side}.{v}").alias(v) for v in values)
    one = both.where("__left IS NOT NULL").select(*keys, "__bin", F.col("__p").alias("__i"), "__a", "__z", *own("__left", a_values))
    two = both.where("__right IS NOT NULL").select(*keys, "__bin", F.col("__p").alias("__j"), F.col("__a").alias("__from"), F.col("__z").alias("__to"), *own("__right", b_values))
    met = one.join(two, [*keys, "__bin"]).where((F.col("__a") <= F.col("__to")) & (F.col("__from") <= F.col("__z")) & (F.col("__bin") == F.greatest(bin_of("__i"), bin_of("__j"))))
    return met.drop("__bin", "__i", "__j")
