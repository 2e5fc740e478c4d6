"""The daily factor panel and the screen over all rebalance dates, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.windows import by, growth, least_rows, momentum, rows, sma, strict, ttm, volatility
from ..operators import screen
from ..operators.asof import asof_columns

FLOWS = ("revenue", "cogs", "net_income", "operating_income", "cfo", "capex")
STOCKS = ("equity", "assets", "debt", "cash", "shares")


@dataclass(frozen=True)
class Metric:
    """A named column builder with the columns that it needs; higher is better unless said otherwise."""

    build: object
    needs: tuple[str, ...]
    category: str = "value"
    higher: bool = True


def _w():
    return by("ticker")


METRICS: dict[str, Metric] = {
    "per": Metric(lambda: safe_div(F.col("close") * F.col("shares"), "net_income_ttm", True), ("close", "shares", "net_income_ttm"), higher=False),
    "pbr": Metric(lambda: safe_div(F.col("close") * F.col("shares"), "equity", True), ("close", "shares", "equity"), higher=False),
    "psr": Metric(lambda: safe_div(F.col("close") * F.col("shares"), "revenue_ttm", True), ("close", "shares", "revenue_ttm"), higher=False),
    "earnings_yield": Metric(lambda: safe_div("net_income_ttm", F.col("close") * F.col("shares"), True), ("close", "shares", "net_income_ttm")),
    "fcf_yield": Metric(lambda: safe_div(F.col("cfo_ttm") - F.col("capex_ttm"), F.col("close") * F.col("shares"), True), ("close", "shares", "cfo_ttm", "capex_ttm")),
    "roe": Metric(lambda: safe_div("net_income_ttm", "equity", True), ("net_income_ttm", "equity"), "quality"),
    "roa": Metric(lambda: safe_div("net_income_ttm", "assets", True), ("net_income_ttm", "assets"), "quality"),
    "gross_margin": Metric(lambda: safe_div(F.col("revenue_ttm") - F.col("cogs_ttm"), "revenue_ttm", True), ("revenue_ttm", "cogs_ttm"), "quality"),
    "dollar_volume_20d": Metric(lambda: F.avg(F.col("close") * F.col("volume")).over(rows(_w(), 20)), ("close", "volume"), "liquidity"),
    "momentum_252": Metric(lambda: momentum("close", _w(), 252), ("close",), "momentum"),
    "momentum_252_21": Metric(lambda: momentum("close", _w(), 252, 21), ("close",), "momentum"),
    "momentum_126": Metric(lambda: momentum("close", _w(), 126), ("close",), "momentum"),
    "momentum_63": Metric(lambda: momentum("close", _w(), 63), ("close",), "momentum"),
    "momentum_21": Metric(lambda: momentum("close", _w(), 21), ("close",), "momentum"),
    "sma_50": Metric(lambda: sma("close", _w(), 50), ("close",), "trend"),
    "sma_200": Metric(lambda: sma("close", _w(), 200), ("close",), "trend"),
    "volatility_20": Metric(lambda: volatility("ret", _w(), 20), ("ret",), "risk", False),
    "volatility_60": Metric(lambda: volatility("ret", _w(), 60), ("ret",), "risk", False),
    "above_sma_200": Metric(lambda: F.coalesce((F.col("close") > sma("close", _w(), 200)).cast("double"), F.lit(0.0)), ("close",), "trend"),
}


def with_metrics(panel: DataFrame, names: Sequence[str], registry: Mapping[str, Metric] = METRICS) -> DataFrame:
    """The named metrics as columns; one whose inputs are missing is null."""
    return panel.withColumns({n: registry[n].build() if set(registry[n].needs) <= set(panel.columns) else F.lit(None).cast("double") for n in names})


def availability_map(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """Whether each metric has any value: one row."""
    return panel.agg(*(F.max(F.col(n).isNotNull()).alias(n) for n in names))


def ttm_statements(statements: DataFrame, flows: Sequence[str] = FLOWS, stocks: Sequence[str] = STOCKS, mode: str = "lenient") -> DataFrame:
    w = by("ticker", order="period_end")
    return statements.select("ticker", "period_end", "available_date", *(ttm(c, w, mode).alias(f"{c}_ttm") for c in flows), *stocks)


def daily_panel(prices: DataFrame, statements: DataFrame, on: str = "available_date", names: Sequence[str] = ()) -> DataFrame:
    """Prices with each statement column's last known value. One shuffle by ticker serves the join and all windows."""
    known = ttm_statements(statements)
    values = [c for c in known.columns if c not in ("ticker", "period_end", "available_date")]
    panel = asof_columns(prices, known, ["ticker"], "date", on, values, "statement_date")
    panel = panel.withColumn("ret", safe_div("close", F.lag("close").over(_w())) - 1)
    return with_metrics(panel, names)


def piotroski(panel: DataFrame, back: int = 252) -> Column:
    """Nine conditions against the row so many days before; a null counts as not met."""
    old = lambda c: F.lag(c, back).over(_w())
    roa, margin, turnover = (safe_div("net_income_ttm", "assets", True), safe_div(F.col("revenue_ttm") - F.col("cogs_ttm"), "revenue_ttm", True), safe_div("revenue_ttm", "assets", True))
    conditions = [
        roa > 0, F.col("cfo_ttm") > 0, F.col("roa_now") > old("roa_now"), F.col("cfo_ttm") > F.col("net_income_ttm"), F.col("leverage_now") < old("leverage_now"),
        F.col("cash_now") > old("cash_now"), F.col("shares") <= old("shares"), F.col("margin_now") > old("margin_now"), F.col("turnover_now") > old("turnover_now"),
    ]
    return sum((F.coalesce(c.cast("int"), F.lit(0)) for c in conditions[1:]), F.coalesce(conditions[0].cast("int"), F.lit(0)))


def with_piotroski(panel: DataFrame, back: int = 252) -> DataFrame:
    now = {
        "roa_now": safe_div("net_income_ttm", "assets", True), "leverage_now": safe_div("debt", "assets", True), "cash_now": safe_div("cash", "debt", True),
        "margin_now": safe_div(F.col("revenue_ttm") - F.col("cogs_ttm"), "revenue_ttm", True), "turnover_now": safe_div("revenue_ttm", "assets", True),
    }
    return panel.withColumns(now).withColumn("f_score", piotroski(panel, back)).drop(*now)


def screen_dates(panel: DataFrame, every: str, where: str, factors: Mapping[str, tuple[float, bool]], n: int, cap: float = 1.0, by_score: bool = False) -> DataFrame:
    """The n best of every rebalance date with their weights: (date, ticker, score, rank, weight). No rule ranks all."""
    dates = screen.rebalance_dates(panel, every)
    section = panel.join(dates, "date", "left_semi").where(screen.rule(where))
    best = screen.ranked(screen.scored(section, factors)).where(F.col("rank") <= n)
    return screen.weighted(best, by_score, cap)


def statement_growth(statements: DataFrame, metrics: Sequence[str], k: int = 4) -> DataFrame:
    w = by("ticker", order="period_end")
    return statements.select("ticker", "period_end", *metrics, *(growth(m, w, k).alias(f"{m}_growth") for m in metrics))


def moving_average_cross(c: str, fast: int, slow: int) -> Column:
    return F.coalesce(strict(F.avg, c, _w(), fast, least_rows(fast)) > strict(F.avg, c, _w(), slow, least_rows(slow)), F.lit(False))
