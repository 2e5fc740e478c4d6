"""Performance of equity curves, grouped by portfolio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.windows import by, drawdown, running_product
from .asof import asof_row

DAYS, YEAR = 252.0, 365.25


def daily_returns(df: DataFrame, keys: Sequence[str], value: str = "equity", flow: str | None = None, date: str = "date") -> DataFrame:
    """ret: (value - flow) / value before - 1, 0 in the first row; curve: the running product of 1 + ret."""
    w = by(*keys, order=date)
    own = F.col(value) - (F.coalesce(F.col(flow), F.lit(0.0)) if flow else F.lit(0.0))
    out = df.withColumn("ret", F.coalesce(safe_div(own, F.lag(value).over(w)) - 1, F.lit(0.0)))
    return out.withColumn("curve", running_product(1 + F.col("ret"), w))


def with_drawdown(df: DataFrame, keys: Sequence[str], value: str = "equity", date: str = "date") -> DataFrame:
    w = by(*keys, order=date)
    return df.withColumns({"peak": F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "drawdown": drawdown(value, w)})


def period_returns(returns: DataFrame, keys: Sequence[str], every: str = "month", ret: str = "ret", date: str = "date") -> DataFrame:
    """Compounded returns by month or year."""
    return returns.groupBy(*keys, F.trunc(date, every).alias("period")).agg((F.product(1 + F.col(ret)) - 1).alias("ret"))


def yearly_change(df: DataFrame, keys: Sequence[str], value: str = "equity", date: str = "date") -> DataFrame:
    """Change between the last values of years."""
    years = df.groupBy(*keys, F.year(date).alias("year")).agg(F.max_by(value, date).alias("last"))
    return years.withColumn("ret", safe_div("last", F.lag("last").over(by(*keys, order="year"))) - 1)


def account_metrics(df: DataFrame, keys: Sequence[str], value: str = "equity", date: str = "date") -> DataFrame:
    """total_return, cagr (365.25 days a year), mdd, vol and sharpe (252 days, sample deviation; 0 below two returns)."""
    rows = with_drawdown(daily_returns(df, keys, value, date=date), keys, value, date)
    n = F.row_number().over(by(*keys, order=date))
    real = F.when(F.col("__n") > 1, F.col("ret"))
    sums = rows.withColumn("__n", n).groupBy(*keys).agg(
        F.min_by(value, date).alias("__a"), F.max_by(value, date).alias("__z"), F.datediff(F.max(date), F.min(date)).alias("__d"), F.min("drawdown").alias("mdd"), F.avg(real).alias("__m"), F.stddev_samp(real).alias("__s"), F.count(real).alias("__k")
    )
    growth = safe_div("__z", "__a", True)
    enough = (F.col("__k") >= 2) & (F.col("__s") > 0)
    return sums.select(
        *keys,
        (growth - 1).alias("total_return"),
        F.when((F.col("__d") > 0) & (growth > 0), F.pow(growth, YEAR / F.nullif(F.col("__d"), F.lit(0))) - 1).alias("cagr"),
        "mdd",
        F.when(F.col("__k") >= 2, F.col("__s") * DAYS**0.5).otherwise(0.0).alias("vol"),
        F.when(enough, F.col("__m") / F.nullif(F.col("__s"), F.lit(0.0)) * DAYS**0.5).otherwise(0.0).alias("sharpe"),
    )


def trade_metrics(trades: DataFrame, curve: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """turnover: traded amounts over mean equity; hit_rate: share of sells with a gain; pnl.

    Where the rows of the trades hold the equity themselves there is no curve, and one aggregate does all.
    """
    sold = F.col("side") == "sell"
    sums = [F.sum(F.abs("notional")).alias("__t"), F.avg(F.when(sold, (F.col("realized_pnl") > 0).cast("int"))).alias("hit_rate"), F.sum("realized_pnl").alias("pnl")]
    mean = F.avg("equity").alias("__e")
    if curve is None:
        both = trades.groupBy(*keys).agg(*sums, mean)
    else:
        both = trades.groupBy(*keys).agg(*sums).join(curve.groupBy(*keys).agg(mean), list(keys), "full")
    return both.select(*keys, safe_div("__t", "__e", True).alias("turnover"), "hit_rate", "pnl")


#: Rates among which the sign of the present value must change. Fixed values.
GRID = (-0.999, -0.9, -0.7, -0.5, -0.2, -0.05, 0.0, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0)


def money_weighted(flows: DataFrame, keys: Sequence[str], amount: str = "amount", date: str = "date", steps: int = 60) -> DataFrame:
    """(keys, mwr): the rate at which the flows' present values cancel, by bisection; null unless flows of both signs bracket a root.

    The first pair of neighbours in GRID between which the value changes its sign is the bracket; roots beyond both ends of GRID are not found. The flows of one account are one array; accounts run in parallel.
    """
    first = flows.withColumn("__y", F.datediff(date, F.min(date).over(Window.partitionBy(*keys))) / YEAR)
    own = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("__y").alias("y"), F.col(amount).alias("a")))).alias("f"))

    def value(rate: Column) -> Column:
        return F.aggregate("f", F.lit(0.0), lambda acc, f: acc + f["a"] * F.pow(1 + rate, -f["y"]))

    grid = F.array(*map(F.lit, GRID))
    own = own.withColumn("__v", F.transform(grid, value))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(len(GRID) - 1)), lambda i: F.element_at("__v", i) * F.element_at("__v", i + 1) <= 0)
    own = own.withColumn("__i", F.try_element_at(pairs, F.lit(1)))
    start = F.struct(F.element_at(grid, F.coalesce("__i", F.lit(1))).alias("lo"), F.element_at(grid, F.coalesce("__i", F.lit(1)) + 1).alias("hi"))
    own = own.withColumn("__s", start)
    sign = F.signum(value(F.col("__s.lo")))
    own = own.withColumn("__g", sign)

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        left = F.signum(value(mid)) == F.col("__g")
        return F.struct(F.when(left, mid).otherwise(acc["lo"]).alias("lo"), F.when(left, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("__s"), halve)
    return own.withColumn("__r", found).select(*keys, F.when(F.col("__i").isNotNull(), (F.col("__r.lo") + F.col("__r.hi")) / 2).alias("mwr"))


def benchmark_units(prices: DataFrame, flows: DataFrame, keys: Sequence[str], date: str = "date", price: str = "close") -> DataFrame:
    """Equity of buying units at each flow: the running sum of flow / price, times the price."""
    both = prices.join(flows, [*keys, date], "left")
    units = F.sum(F.coalesce(safe_div("flow", price, True), F.lit(0.0))).over(by(*keys, order=date).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("equity", units * F.col(price))


def excess(own: DataFrame, benchmark: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Both curves side by side: excess (running sum of return differences) and relative (ratio of curves - 1)."""
    right = benchmark.select(*keys, date, F.col("ret").alias("__r"), F.col("curve").alias("__c"))
    both = own.join(right, [*keys, date])
    w = by(*keys, order=date).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({"excess": F.sum(F.col("ret") - F.col("__r")).over(w), "relative": safe_div("curve", "__c", True) - 1}).drop("__r", "__c")


def held_returns(weights: DataFrame, prices: DataFrame, date: str = "date", price: str = "close") -> DataFrame:
    """(date, value, curve): weights are bought at exec_date and held to the next one, at closing prices; the curve chains the periods.

    weights: (exec_date, next_date, ticker, weight). What is not invested is cash.
    """
    bought = weights.join(prices.select("ticker", F.col(date).alias("exec_date"), F.col(price).alias("__p0")), ["ticker", "exec_date"])
    # each price row meets the last purchase of its ticker alone; the closing day of a period belongs to the next one too
    last = asof_row(prices.select("ticker", date, price), bought.withColumn("__from", F.col("exec_date")), ["ticker"], date, "__from", ["exec_date", "next_date", "weight", "__p0"])
    closing = bought.join(prices.select("ticker", F.col(date), F.col(date).alias("next_date"), price), ["ticker", "next_date"])
    cols = ["exec_date", "next_date", "weight", "__p0", "ticker", date, price]
    held = last.where((F.col(date) >= F.col("exec_date")) & (F.col(date) < F.col("next_date"))).select(*cols).unionByName(closing.where(F.col("exec_date") <= F.col("next_date")).select(*cols))
    value = F.sum(F.col("weight") * (F.col(price) / F.col("__p0") - 1)) + 1
    days = held.groupBy("exec_date", "next_date", date).agg(value.alias("value"))
    ends = days.groupBy("exec_date").agg(F.max_by("value", date).alias("__end"))
    chain = F.coalesce(F.product("__end").over(Window.partitionBy(F.lit(0)).orderBy("exec_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    base = ends.withColumn("__base", chain).drop("__end")
    return days.join(base, "exec_date").select("exec_date", date, "value", (F.col("__base") * F.col("value")).alias("curve"))


def trade_pivot(trades: DataFrame, every: str = "month", sides: Sequence[str] = ("buy", "sell")) -> DataFrame:
    """Traded amounts by ticker and month, a column per side."""
    return trades.groupBy("ticker", F.trunc("date", every).alias("period")).pivot("side", list(sides)).agg(F.sum("notional"))
