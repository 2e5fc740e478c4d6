"""Quarterly statements: annual rows, quarters from running totals, pivots, and repairs of single values."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.windows import by


def annual_calendar(df: DataFrame, flows: Sequence[str], stocks: Sequence[str], key: str = "ticker") -> DataFrame:
    """Per calendar year: flows summed (null if all are), stocks of the last row even if null, availability at its latest."""
    return df.groupBy(key, F.year("period_end").alias("year")).agg(*(F.sum(c).alias(c) for c in flows), *(F.max_by(F.struct(c), "period_end").getField(c).alias(c) for c in stocks), F.max("available_date").alias("available_date")).withColumn("period_end", F.make_date("year", F.lit(12), F.lit(31)))


def annual_fiscal(df: DataFrame, flows: Sequence[str], stocks: Sequence[str], last_value: bool = True, key: str = "ticker") -> DataFrame:
    """Per fiscal year: stocks are the last value (last_value) or the last row's."""
    stock = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("period_end"))) if last_value else F.max_by(F.struct(c), "period_end").getField(c)
    return df.groupBy(key, "fiscal_year").agg(*(F.sum(c).alias(c) for c in flows), *(stock(c).alias(c) for c in stocks), F.max("period_end").alias("period_end"))


def annual_complete(df: DataFrame, flows: Sequence[str], stocks: Sequence[str], key: str = "ticker") -> DataFrame:
    """Only years with one row for each of four quarters; a flow needs four values."""
    years = df.groupBy(key, "fiscal_year").agg(*(F.when(F.count(c) == 4, F.sum(c)).alias(c) for c in flows), *(F.max_by(F.struct(c), "period_end").getField(c).alias(c) for c in stocks), F.count("*").alias("__n"), F.count_distinct("fiscal_quarter").alias("__q"), F.max("period_end").alias("period_end"))
    return years.where("__n = 4 AND __q = 4").drop("__n", "__q")


def annual_latest(df: DataFrame, key: str = "ticker") -> DataFrame:
    """The last row of each year."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key, F.year("period_end").alias("year")).agg(F.max_by(F.struct(*rest), "period_end").alias("r")).select(key, "year", "r.*")


def annual_by_rules(df: DataFrame, rules: Mapping[str, str], key: str = "ticker") -> DataFrame:
    """Per column `sum` of the quarters, or `last`: the fourth quarter's value; n_quarters counts the quarters."""
    value = lambda c, rule: F.sum(c) if rule == "sum" else F.max_by(c, "fiscal_quarter")
    return df.groupBy(key, "fiscal_year").agg(*(value(c, r).alias(c) for c, r in rules.items()), F.count_distinct("fiscal_quarter").alias("n_quarters"))


def wide(facts: DataFrame, keys: Sequence[str], metrics: Sequence[str], order: Sequence[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """A column per metric: the last value by order."""
    return facts.groupBy(*keys).pivot(metric, list(metrics)).agg(F.max_by(value, F.struct(*order)))


def conditional_sums(facts: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column], value: str = "value") -> DataFrame:
    return facts.groupBy(*keys).agg(*(F.sum(F.when(c, F.col(value))).alias(n) for n, c in metrics.items()))


def decumulate(df: DataFrame, value: str, keys: Sequence[str] = ("ticker", "fiscal_year"), quarter: str = "fiscal_quarter") -> Column:
    """Q1 as it is; later quarters less the row before; null where that is null."""
    return F.when(F.col(quarter) == 1, F.col(value)).otherwise(F.col(value) - F.lag(value).over(by(*keys, order=quarter)))


def decumulate_voted(df: DataFrame, value: str, name: str, key: str = "ticker") -> DataFrame:
    """Quarters from values that are either running totals or already quarters, by majority of the years.

    A year votes for running totals where the second quarter is above 1.3 times the first, and for a fourth
    quarter that stands alone where it is below 0.6 times the sum of the three before.
    """
    q = lambda k: F.max(F.when(F.col("fiscal_quarter") == k, F.col(value)))
    years = df.groupBy(key, "fiscal_year").agg(*(q(k).alias(f"__{k}") for k in (1, 2, 3, 4)))
    votes = years.groupBy(key).agg((F.avg((F.col("__2") > 1.3 * F.col("__1")).cast("int")) > 0.5).alias("cumulative"), (F.avg((F.col("__4") < 0.6 * (F.col("__1") + F.col("__2") + F.col("__3"))).cast("int")) > 0.5).alias("q4_alone"))
    w = by(key, "fiscal_year", order="fiscal_quarter")
    before = F.lag(value).over(w)
    own = F.when((F.col("fiscal_quarter") == 1) | ~F.coalesce("cumulative", F.lit(False)), F.col(value)).when((F.col("fiscal_quarter") == 4) & F.col("q4_alone"), F.col(value)).otherwise(F.col(value) - before)
    return df.join(votes, key, "left").withColumns({name: own, "derivable": own.isNotNull()})


def fill_fourth_quarter(df: DataFrame, annual: str, value: str, name: str, key: str = "ticker", near: float = 0.03) -> DataFrame:
    """Q4 = year - the three quarters before, where Q4 is null or within 3 % of the year, and the quarters are 70 to 130 days apart."""
    w = by(key, order="period_end")
    gaps = [F.datediff(F.lag("period_end", k - 1).over(w) if k > 1 else F.col("period_end"), F.lag("period_end", k).over(w)).between(70, 130) for k in (1, 2, 3)]
    rest = F.col(annual) - sum((F.lag(value, k).over(w) for k in (2, 3)), F.lag(value, 1).over(w))
    whole = F.abs(F.col(value) - F.col(annual)) <= near * F.abs(F.col(annual))
    mend = (F.col("fiscal_quarter") == 4) & F.coalesce(gaps[0] & gaps[1] & gaps[2], F.lit(False)) & (F.col(value).isNull() | F.coalesce(whole, F.lit(False))) & rest.isNotNull()
    return df.withColumn(name, F.when(mend, rest).otherwise(F.col(value)))


def december_to_quarter(df: DataFrame, value: str, name: str, key: str = "ticker") -> DataFrame:
    """A December value above 1.2 times what the year had before is a year: less the earlier part, if that is not negative."""
    w = Window.partitionBy(key, F.year("period_end")).orderBy("period_end").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.sum(value).over(w)
    annual = (F.month("period_end") == 12) & (F.col(value) > 1.2 * F.abs(earlier)) & (F.col(value) - earlier >= 0)
    return df.withColumn(name, F.when(annual, F.col(value) - earlier).otherwise(F.col(value)))


def smoothed_twice(values: Column) -> Column:
    """Two passes from left to right over an ordered array: a value outside half and twice the mean of its neighbours becomes that mean."""

    def once(v: Column) -> Column:
        n = F.size(v)

        def step(acc: Column, i: Column) -> Column:
            x, after = F.get(v, i), F.get(v, i + 1)
            mean = (F.try_element_at(acc, F.lit(-1)) + after) / 2
            odd = (i > 0) & (i < n - 1) & (mean != 0) & ~(x / mean).between(0.5, 2)
            return F.concat(acc, F.array(F.when(F.coalesce(odd, F.lit(False)), mean).otherwise(x)))

        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<double>"), step)).otherwise(v)

    # a lambda's variable is computed once, an expression wherever it stands
    bound = lambda v: F.get(F.transform(F.array(v), once), F.lit(0))
    return bound(bound(values))


def drop_leading_annual(df: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows that hold a year as a fourth quarter go while no genuine quarter came before."""
    w = by(key, order="period_end")
    odd = (F.col("form") == "FY") & (F.col("fiscal_quarter") == 4)
    genuine = F.max((~odd).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__g", genuine).where((F.col("__g") == 1) | ~odd).drop("__g")


def last_years(df: DataFrame, n: int, per_year: int = 4, key: str = "ticker") -> DataFrame:
    """The last n years of rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col("period_end").desc())
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n * per_year).drop("__n")


def average_balance(c: str, w) -> Column:
    """Mean of the row and the one before."""
    return (F.col(c) + F.lag(c).over(w)) / 2


def working_capital_change(w, receivables: str = "receivables", inventory: str = "inventory", payables: str = "payables") -> Column:
    """Change of receivables + inventory - payables; null only where all three changes are."""
    change = lambda c: F.col(c) - F.lag(c).over(w)
    parts = [change(receivables), change(inventory), -change(payables)]
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0))))


#: Split factors that a jump of shares is taken for. Fixed values.
SPLITS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 25, 28)


def mend_split_jumps(values: Column, splits: Column | None = None, factors: Sequence[float] = SPLITS) -> Column:
    """Shares that jump by about a split factor (12 %) against the mended value before go back to its level; the first factor that fits counts.

    splits: for each value the product of the known splits since the one before; a jump within 25 % of it, either way, stays.
    Arrays hold quarters, some hundreds at most.
    """
    pairs = F.arrays_zip(values.alias("v"), splits.alias("s")) if splits is not None else F.transform(values, lambda v: F.struct(v.alias("v"), F.lit(1.0).alias("s")))

    def mended(before: Column, p: Column) -> Column:
        x, known, ratio = p["v"], F.coalesce(p["s"], F.lit(1.0)), p["v"] / F.nullif(before, F.lit(0.0))
        explained = (known > 1) & ((F.abs(ratio - known) <= 0.25 * known) | (F.abs(1 / F.nullif(ratio, F.lit(0.0)) - known) <= 0.25 * known))
        out = x
        for f in reversed(factors):
            out = F.when(F.abs(ratio - f) <= 0.12 * f, x / f).when(F.abs(ratio - 1 / f) <= 0.12 / f, x * f).otherwise(out)
        return F.when(F.coalesce((before <= 0) | (x <= 0), F.lit(True)) | ratio.between(0.5, 2) | F.coalesce(explained, F.lit(False)), x).otherwise(out)

    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        own = mended(acc["last"], p)
        return F.struct(own.alias("last"), F.concat(acc["out"], F.array(own)).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def split_factor(w: Window, ratio: str) -> Column:
    """Product of the later splits."""
    return F.coalesce(F.product(F.coalesce(ratio, F.lit(1.0))).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))


def scale_repair(c: str, w, votes: Column) -> Column:
    """A value about 1e3 or 1e6 times both neighbours is scaled down where the other columns vote for it."""
    around = (F.lag(c).over(w) + F.lead(c).over(w)) / 2
    ratio = safe_div(c, around)
    return F.when(votes & ratio.between(500, 2000), F.col(c) / 1e3).when(votes & ratio.between(5e5, 2e6), F.col(c) / 1e6).otherwise(F.col(c))


def smooth_outlier(c: str, w) -> Column:
    """A value outside half and twice the mean of its neighbours becomes that mean."""
    mean = (F.lag(c).over(w) + F.lead(c).over(w)) / 2
    return F.when(mean.isNotNull() & (mean != 0) & ~(F.col(c) / mean).between(0.5, 2), mean).otherwise(F.col(c))


def fiscal_gaps(df: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, missing, duplicates): quarters lacking or repeated between the first and the last."""
    keyed = df.select(key, (F.col("fiscal_year") * 4 + F.col("fiscal_quarter")).alias("k"))
    step = F.lead("k").over(by(key, order="k")) - F.col("k")
    return keyed.withColumn("__s", step).groupBy(key).agg(F.coalesce(F.sum(F.greatest(F.col("__s") - 1, F.lit(0))), F.lit(0)).cast("long").alias("missing"), F.count_if(F.col("__s") == 0).alias("duplicates"))


def revision_panel(filings: DataFrame, metrics: Sequence[str], key: str = "ticker", quarters: int = 4) -> DataFrame:
    """What was known at each availability date: the newest filing of every period, TTM sums over the last four periods, for the latest period.

    A later filing replaces an earlier one from its own date on, never before. One shuffle and sort by key; then an ordered pass
    carries the newest filing of the last four periods and gives a row at each date, so a key's history is never held, joined or
    collected. Filings without key, availability date or period go; metrics are doubles.
    """
    order = [key, "available_date", "period_end", F.col("filing_date").asc_nulls_first(), F.col("version").asc_nulls_first()]
    rows = filings.where(F.col(key).isNotNull() & F.col("available_date").isNotNull() & F.col("period_end").isNotNull())
    # days travel as numbers, which Python reads and compares faster than dates
    numbers = {c for c in ("available_date", "period_end", "filing_date") if dict(filings.dtypes)[c] == "date"}
    days = [F.unix_date(c).alias(c) if c in numbers else F.col(c) for c in ("available_date", "period_end", "filing_date")]
    rows = rows.select(key, *days, "version", *(F.col(m).cast("double").alias(m) for m in metrics)).repartition(key).sortWithinPartitions(*order).drop("version")
    names = [key, "event_date", "period_end", *(f"{m}_ttm" for m in metrics)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}

        def event() -> tuple:
            held = [known[p][1] for p in sorted(known)]
            sums = (sum(v) if len(held) == quarters and None not in v else None for v in zip(*held, strict=True))
            return (*now, max(known), *sums)

        def batch(found: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
            day = lambda c: pa.int32() if c in numbers else pa.date32()
            types = [kinds.field(key).type, day("available_date"), day("period_end"), *[pa.float64()] * len(metrics)]
            cols = [pa.array(v, t) for v, t in zip(zip(*found, strict=True) if found else [()] * len(types), types, strict=True)]
            return pa.RecordBatch.from_arrays([cols[0], cols[1].cast(pa.date32()), cols[2].cast(pa.date32()), *cols[3:]], names=names)

        kinds = None
        for part in batches:
            found, kinds = [], part.schema
            for own, at, period, filed, *values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if now != (own, at):
                    if now:
                        found.append(event())
                        known = known if now[0] == own else {}
                    now = (own, at)
                rank = (filed is not None, filed, at)
                if period not in known or rank >= known[period][0]:  # of one date and filing date the newest version comes last
                    known[period] = (rank, values)
                if len(known) > quarters:
                    del known[min(known)]
            yield batch(found, kinds)
        if now:
            yield batch([event()], kinds)

    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, event_date date, period_end date, " + ", ".join(f"`{m}_ttm` double" for m in metrics))


def derived_factors(df: DataFrame, flows: Sequence[str], stocks: Sequence[str], ratios: Mapping[str, Column], key: str = "ticker") -> DataFrame:
    """The ratios on three bases, as rows: quarter, ttm (strict sums of flows) and annual (calendar years)."""
    from ..functions.windows import ttm

    w = by(key, order="period_end")
    keep = [key, "period_end", "available_date"]
    quarter = df.select(*keep, *flows, *stocks, F.lit("quarter").alias("basis"))
    rolling = df.select(*keep, *(ttm(c, w).alias(c) for c in flows), *stocks, F.lit("ttm").alias("basis"))
    annual = annual_calendar(df, flows, stocks, key).select(*keep, *flows, *stocks, F.lit("annual").alias("basis"))
    return quarter.unionByName(rolling).unionByName(annual).select(*keep, "basis", *(c.alias(n) for n, c in ratios.items()))
