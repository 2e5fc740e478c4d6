"""Queries over prices and statements: scans, windows, as-of joins, panels, screens, performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as col
from ..functions import windows as win
from ..operators import asof, dedupe, perf, quality, scan, screen
from ..operators import statements as st
from ..sources import adapters as ad
from ..sources import io
from . import panel as pl
from .registry import BARS, FILINGS, STATEMENTS, query


def _round(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(BARS, twin="SELECT * FROM bars")
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.prices(spark, sf_dir)


@query(twin="SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 30 AND l_returnflag IN ('A', 'R') AND l_discount < 0.03")
def scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_table(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_extendedprice", "unknown"], [("l_quantity", ">=", 30.0), ("l_returnflag", "in", ["A", "R"]), ("l_discount", "<", 0.03)])


@query(BARS, twin="SELECT ticker, date, close FROM bars WHERE ticker IN (3, 5, 7, 11) AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def bulk_price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.bulk_prices(ad.prices(spark, sf_dir), [3, 5, 7, 11], "1996-01-01", "1999-12-31")


@query(BARS, twin="SELECT DISTINCT ticker FROM bars")
def available_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.prices(spark, sf_dir).select("ticker").distinct()


@query(STATEMENTS, twin="SELECT * FROM stmts")
def quarterly_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.statements(spark, sf_dir)


_Q = "PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW"


def _ttm(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    w = win.by("ticker", order="period_end")
    return ad.statements(spark, sf_dir).select("ticker", "period_end", *(F.round(win.ttm(c, w, mode), 4).alias(f"{c}_ttm") for c in ("revenue", "opex")))


@query(STATEMENTS, twin=f"SELECT ticker, period_end, sum(revenue) OVER ({_Q}) AS revenue_ttm, sum(opex) OVER ({_Q}) AS opex_ttm FROM stmts")
def ttm_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ttm(spark, sf_dir, "lenient")


@query(STATEMENTS, twin=f"SELECT ticker, period_end, CASE WHEN count(revenue) OVER ({_Q}) = 4 THEN sum(revenue) OVER ({_Q}) END AS revenue_ttm, CASE WHEN count(opex) OVER ({_Q}) = 4 THEN sum(opex) OVER ({_Q}) END AS opex_ttm FROM stmts")
def ttm_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ttm(spark, sf_dir, "strict")


@query(STATEMENTS, twin=f"SELECT ticker, period_end, round(sum(revenue) OVER ({_Q}) / count(revenue) OVER ({_Q}) * 4, 4) AS revenue_ttm, round(sum(opex) OVER ({_Q}) / count(opex) OVER ({_Q}) * 4, 4) AS opex_ttm FROM stmts")
def ttm_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ttm(spark, sf_dir, "partial")


@query(STATEMENTS, twin="SELECT ticker, year(period_end) AS year, sum(revenue) AS revenue, sum(opex) AS opex, arg_max(equity, period_end) AS equity, max(available_date) AS available_date, make_date(year(period_end), 12, 31) AS period_end FROM stmts GROUP BY ticker, year(period_end)")
def annual_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.annual_calendar(ad.statements(spark, sf_dir), ["revenue", "opex"], ["equity"])


@query(STATEMENTS, twin="""SELECT ticker, fiscal_year, CASE WHEN count(revenue) = 4 THEN sum(revenue) END AS revenue, CASE WHEN count(opex) = 4 THEN sum(opex) END AS opex, arg_max(equity, period_end) AS equity, max(period_end) AS period_end
 FROM stmts GROUP BY ticker, fiscal_year HAVING count(*) = 4 AND count(DISTINCT fiscal_quarter) = 4""")
def annual_complete_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.annual_complete(ad.statements(spark, sf_dir), ["revenue", "opex"], ["equity"])


@query(STATEMENTS, twin="""SELECT ticker, fiscal_year, sum(revenue) AS revenue, (SELECT s.opex FROM stmts s WHERE s.ticker = t.ticker AND s.fiscal_year = t.fiscal_year AND s.opex IS NOT NULL ORDER BY s.period_end DESC LIMIT 1) AS opex, max(period_end) AS period_end
 FROM stmts t GROUP BY ticker, fiscal_year""")
def annual_fiscal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.annual_fiscal(ad.statements(spark, sf_dir), ["revenue"], ["opex"])


@query(BARS, STATEMENTS, twin="""SELECT b.ticker, b.date, b.close,
  (SELECT s.revenue FROM stmts s WHERE s.ticker = b.ticker AND s.available_date <= b.date AND s.revenue IS NOT NULL ORDER BY s.available_date DESC LIMIT 1) AS revenue,
  (SELECT s.opex FROM stmts s WHERE s.ticker = b.ticker AND s.available_date <= b.date AND s.opex IS NOT NULL ORDER BY s.available_date DESC LIMIT 1) AS opex,
  (SELECT max(s.available_date) FROM stmts s WHERE s.ticker = b.ticker AND s.available_date <= b.date) AS statement_date FROM bars b""")
def asof_ffill_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ad.prices(spark, sf_dir).select("ticker", "date", "close")
    return asof.asof_columns(left, ad.statements(spark, sf_dir), ["ticker"], "date", "available_date", ["revenue", "opex"], "statement_date")


@query(BARS, STATEMENTS, twin="""SELECT b.ticker, b.date, s.revenue, s.opex FROM bars b ASOF LEFT JOIN stmts s ON b.ticker = s.ticker AND b.date >= s.available_date""")
def asof_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ad.prices(spark, sf_dir).select("ticker", "date")
    return asof.asof_row(left, ad.statements(spark, sf_dir), ["ticker"], "date", "available_date", ["revenue", "opex"])


@query(BARS, STATEMENTS, twin="""SELECT b.ticker, b.date, CASE WHEN b.date <= s.available_date + 60 THEN s.form ELSE 'none' END AS form FROM bars b ASOF LEFT JOIN stmts s ON b.ticker = s.ticker AND b.date >= s.available_date""")
def asof_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = ad.statements(spark, sf_dir).withColumn("valid_to", F.date_add("available_date", 60))
    return asof.asof_bounded(ad.prices(spark, sf_dir).select("ticker", "date"), right, ["ticker"], "date", "available_date", "valid_to", ["form"], "none")


@query(BARS, STATEMENTS, twin="""SELECT s.ticker, s.period_end, s.revenue, b.close AS price FROM stmts s ASOF LEFT JOIN bars b ON s.ticker = b.ticker AND s.period_end >= b.date""")
def price_at_period_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ad.statements(spark, sf_dir).select("ticker", "period_end", "revenue")
    return asof.at_period_end(left, ad.prices(spark, sf_dir), ["ticker"], "period_end", "date", ["adj_close", "close"], "price")


@query(BARS, STATEMENTS, twin="""SELECT b.ticker, b.date, b.close * CASE WHEN s.shares > 0 THEN s.shares END AS market_cap FROM bars b ASOF LEFT JOIN stmts s ON b.ticker = s.ticker AND b.date >= s.available_date""")
def market_cap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ad.prices(spark, sf_dir).select("ticker", "date", "close")
    out = asof.asof_columns(left, ad.statements(spark, sf_dir), ["ticker"], "date", "available_date", ["shares"])
    return out.select("ticker", "date", (F.col("close") * F.when(F.col("shares") > 0, F.col("shares"))).alias("market_cap"))


@query(FILINGS, twin="""SELECT ticker, period_end, version, filing_date, revenue FROM filings WHERE available_date <= DATE '1999-06-30'
 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC, filing_date DESC, version DESC) = 1""")
def pit_latest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedupe.latest_as_of(ad.filings(spark, sf_dir), "ticker", F.lit("1999-06-30").cast("date"), order=("period_end", "filing_date", "version"))
    return found.select("ticker", "period_end", "version", "filing_date", "revenue")


@query(FILINGS, twin="""SELECT ticker, period_end, max(version) AS version, arg_max(revenue, version) AS revenue,
 (SELECT f.opex FROM filings f WHERE f.ticker = t.ticker AND f.period_end = t.period_end AND f.opex IS NOT NULL ORDER BY f.version DESC LIMIT 1) AS opex FROM filings t GROUP BY ticker, period_end""")
def pit_backfill_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.fill_from_earlier(ad.filings(spark, sf_dir), ["ticker", "period_end"], ["revenue", "opex"], ["version"], ["version"])


PANEL_TWIN = """SELECT ticker, event_date, max(period_end) AS period_end, CASE WHEN count(revenue) = 4 THEN sum(revenue) END AS revenue_ttm, CASE WHEN count(net_income) = 4 THEN sum(net_income) END AS net_income_ttm FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, event_date ORDER BY period_end DESC) AS n FROM (
    SELECT f.ticker, e.event_date, f.period_end, f.revenue, f.net_income FROM (SELECT DISTINCT ticker, available_date AS event_date FROM filings) e JOIN filings f ON f.ticker = e.ticker AND f.available_date <= e.event_date
    QUALIFY row_number() OVER (PARTITION BY f.ticker, e.event_date, f.period_end ORDER BY f.filing_date DESC, f.version DESC) = 1)) WHERE n <= 4 GROUP BY ticker, event_date"""


@query(FILINGS, twin=PANEL_TWIN)
def pit_revision_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.revision_panel(ad.filings(spark, sf_dir), ["revenue", "net_income"])


_W = "PARTITION BY ticker ORDER BY date"


def _sixths(e: str) -> str:
    return f"floor(({e}) * 1e6 + 0.5) / 1e6"


_SPANS = {"m252": (252, 0), "m252_21": (252, 21), "m126": (126, 0), "m63": (63, 0), "m21": (21, 0)}


@query(BARS, twin="SELECT ticker, date, " + ", ".join(_sixths(f"{f'lag(close, {s}) OVER ({_W})' if s else 'close'} / lag(close, {n}) OVER ({_W}) - 1") + f" AS {k}" for k, (n, s) in _SPANS.items()) + " FROM bars")
def momentum_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.by("ticker")
    return ad.prices(spark, sf_dir).select("ticker", "date", *((F.floor(win.momentum("close", w, *s) * 1e6 + 0.5) / 1e6).alias(n) for n, s in _SPANS.items()))


_R = f"r AS (SELECT ticker, date, close, high, low, volume, close / lag(close) OVER ({_W}) - 1 AS ret, close - lag(close) OVER ({_W}) AS chg FROM bars)"


def _frame(k: int) -> str:
    return f"({_W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


@query(BARS, _R, twin=f"""SELECT ticker, date, CASE WHEN count(ret) OVER {_frame(20)} >= 5 THEN round(stddev_samp(ret) OVER {_frame(20)} * sqrt(252), 6) END AS vol20,
 CASE WHEN count(ret) OVER {_frame(60)} >= 15 THEN round(stddev_samp(ret) OVER {_frame(60)} * sqrt(252), 6) END AS vol60 FROM r""")
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.by("ticker")
    rows = ad.prices(spark, sf_dir).withColumn("ret", win.lag_pct("close", w))
    return rows.select("ticker", "date", F.round(win.volatility("ret", w, 20), 6).alias("vol20"), F.round(win.volatility("ret", w, 60), 6).alias("vol60"))


@query(BARS, _R, twin=f"""SELECT ticker, date, CASE WHEN count(close) OVER {_frame(50)} >= 12 THEN round(avg(close) OVER {_frame(50)}, 6) END AS sma50,
 CASE WHEN count(chg) OVER {_frame(14)} >= 14 AND avg(greatest(-chg, 0 * chg)) OVER {_frame(14)} <> 0 THEN round(100 - 100 / (1 + avg(greatest(chg, 0 * chg)) OVER {_frame(14)} / avg(greatest(-chg, 0 * chg)) OVER {_frame(14)}), 5) END AS rsi14,
 CASE WHEN count(close) OVER {_frame(20)} >= 10 AND stddev_samp(close) OVER {_frame(20)} <> 0 THEN round((close - avg(close) OVER {_frame(20)}) / (2 * stddev_samp(close) OVER {_frame(20)}), 5) END AS boll FROM r""")
def sma_rsi_boll(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.by("ticker")
    rows = ad.prices(spark, sf_dir).withColumn("chg", F.col("close") - F.lag("close").over(w))
    return rows.select("ticker", "date", F.round(win.sma("close", w, 50), 6).alias("sma50"), F.round(win.rsi("close", w, 14, "chg"), 5).alias("rsi14"), F.round(win.bollinger_z("close", w), 5).alias("boll"))


@query(BARS, twin=f"""SELECT ticker, date, CASE WHEN count(high) OVER {_frame(9)} = 9 THEN (max(high) OVER {_frame(9)} + min(low) OVER {_frame(9)}) / 2 END AS conversion,
 CASE WHEN count(high) OVER {_frame(26)} = 26 THEN (max(high) OVER {_frame(26)} + min(low) OVER {_frame(26)}) / 2 END AS base,
 lead(close, 26) OVER ({_W}) AS lagging FROM bars""")
def ichimoku(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.by("ticker")
    return ad.prices(spark, sf_dir).select("ticker", "date", win.ichimoku(w, 9).alias("conversion"), win.ichimoku(w, 26).alias("base"), F.lead("close", 26).over(w).alias("lagging"))


@query(BARS, "n AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM bars)", twin="""SELECT ticker, date, round(list_reduce(list_prepend(close0, rest), lambda a, x: 2.0 / 13 * x + (1 - 2.0 / 13) * a), 4) AS ema12 FROM (
  SELECT ticker, date, first(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close0, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)[2:] AS rest FROM n)""")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.exponential_means(ad.prices(spark, sf_dir), ["ticker"], "close", {"ema12": 12})
    return out.select("ticker", "date", F.round("ema12", 4).alias("ema12"))


@query(BARS, twin=f"""SELECT ticker, date, max(close) OVER ({_W}) AS peak, round(close / max(close) OVER ({_W}) - 1, 6) AS drawdown FROM bars""")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(perf.with_drawdown(ad.prices(spark, sf_dir).select("ticker", "date", "close"), ["ticker"], "close").drop("close"))


_RET = f"ret AS (SELECT ticker, date, close, coalesce(close / lag(close) OVER ({_W}) - 1, 0) AS ret, row_number() OVER ({_W}) AS n FROM bars)"


@query(BARS, _RET, twin="SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS period, round(product(1 + ret) - 1, 5) AS ret FROM ret GROUP BY 1, 2")
def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perf.daily_returns(ad.prices(spark, sf_dir), ["ticker"], "close")
    return _round(perf.period_returns(rows, ["ticker"]), 5)


@query(BARS, _RET, twin="""SELECT ticker, round(arg_max(close, date) / arg_min(close, date) - 1, 6) AS total_return, round(pow(arg_max(close, date) / arg_min(close, date), 365.25 / date_diff('day', min(date), max(date))) - 1, 5) AS cagr, round(min(dd), 6) AS mdd,
 round(stddev_samp(CASE WHEN n > 1 THEN ret END) * sqrt(252), 5) AS vol, round(avg(CASE WHEN n > 1 THEN ret END) / stddev_samp(CASE WHEN n > 1 THEN ret END) * sqrt(252), 5) AS sharpe
 FROM (SELECT *, close / max(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM ret) GROUP BY ticker""")
def perf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perf.account_metrics(ad.prices(spark, sf_dir), ["ticker"], "close")
    return out.select("ticker", F.round("total_return", 6).alias("total_return"), F.round("cagr", 5).alias("cagr"), F.round("mdd", 6).alias("mdd"), F.round("vol", 5).alias("vol"), F.round("sharpe", 5).alias("sharpe"))


_GRID = "-0.999, -0.9, -0.7, -0.5, -0.2, -0.05, 0.0, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0"
_PRESENT = "list_sum(list_transform(f, lambda x: x.a * pow(1 + {0}, -x.y)))"


@query("RECURSIVE fl AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS a FROM orders)", "fy AS (SELECT account, a, date_diff('day', min(d) OVER (PARTITION BY account), d) / 365.25::DOUBLE AS y FROM fl)", "ar AS (SELECT account, list({'y': y, 'a': a} ORDER BY y, a) AS f FROM fy GROUP BY account)",
    f"gv AS (SELECT account, f, list_transform([{_GRID}]::DOUBLE[], lambda r: {_PRESENT.format('r')}) AS v FROM ar)", "gi AS (SELECT account, f, list_filter(generate_series(1, 14), lambda i: v[i] * v[i + 1] <= 0)[1] AS i FROM gv)",
    f"b0 AS (SELECT account, f, ([{_GRID}]::DOUBLE[])[i] AS lo, ([{_GRID}]::DOUBLE[])[i + 1] AS hi FROM gi WHERE i IS NOT NULL)", f"b AS (SELECT account, f, lo, hi, sign({_PRESENT.format('lo')}) AS s, 0 AS n FROM b0 UNION ALL SELECT account, f, CASE WHEN same THEN mid ELSE lo END, CASE WHEN same THEN hi ELSE mid END, s, n + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, sign({_PRESENT.format('((lo + hi) / 2)')}) = s AS same FROM b WHERE n < 60))",
    twin="SELECT account, round((lo + hi) / 2, 6) AS mwr FROM b WHERE n = 60 UNION ALL SELECT account, NULL FROM gi WHERE i IS NULL")
def mwr_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = ad.table(spark, sf_dir, "orders")
    flows = orders.select(F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("amount"))
    return perf.money_weighted(flows, ["account"]).withColumn("mwr", F.round("mwr", 6))


@query(BARS, twin=f"""SELECT year(date) AS year, ticker, arg_max(close, date) AS last, round(arg_max(close, date) / lag(arg_max(close, date)) OVER (PARTITION BY ticker ORDER BY year(date)) - 1, 6) AS ret FROM bars GROUP BY ticker, year(date)""")
def yearly_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(perf.yearly_change(ad.prices(spark, sf_dir), ["ticker"], "close"))


_KNOWN = f"""known AS (SELECT ticker, period_end, available_date, equity, assets, debt, cash, shares, sum(revenue) OVER ({_Q}) AS revenue_ttm, sum(cogs) OVER ({_Q}) AS cogs_ttm, sum(net_income) OVER ({_Q}) AS net_income_ttm,
  sum(operating_income) OVER ({_Q}) AS operating_income_ttm, sum(cfo) OVER ({_Q}) AS cfo_ttm, sum(capex) OVER ({_Q}) AS capex_ttm FROM stmts)"""
_PANEL = f"""panel AS (SELECT b.ticker, b.date, b.close, b.volume, k.* EXCLUDE (ticker), avg(b.close * b.volume) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS dv, b.close / lag(b.close, 126) OVER (PARTITION BY b.ticker ORDER BY b.date) - 1 AS m126
  FROM bars b ASOF LEFT JOIN known k ON b.ticker = k.ticker AND b.date >= k.available_date)"""


def _panel(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return pl.daily_panel(ad.prices(spark, sf_dir), ad.statements(spark, sf_dir), names=names)


@query(BARS, STATEMENTS, _KNOWN, _PANEL, twin="""SELECT ticker, date, CASE WHEN net_income_ttm > 0 THEN round(close * shares / net_income_ttm, 6) END AS per, CASE WHEN equity > 0 THEN round(close * shares / equity, 6) END AS pbr,
 CASE WHEN revenue_ttm > 0 THEN round(close * shares / revenue_ttm, 6) END AS psr, round(net_income_ttm / (close * shares), 6) AS earnings_yield, round((cfo_ttm - capex_ttm) / (close * shares), 6) AS fcf_yield FROM panel""")
def valuation_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("per", "pbr", "psr", "earnings_yield", "fcf_yield")
    return _round(_panel(spark, sf_dir, *names).select("ticker", "date", *names))


_PRICED = """vr AS (SELECT s.* REPLACE (CASE WHEN fiscal_quarter = 3 THEN NULL ELSE debt END AS debt, CASE WHEN s.ticker % 11 = 0 THEN 0 ELSE shares END AS shares), operating_income + n_lines * 50 AS ebitda, interest AS dividends, b.close FROM stmts s ASOF LEFT JOIN bars b ON b.ticker = s.ticker AND s.period_end >= b.date)"""


@query(STATEMENTS, BARS, _PRICED, "x AS (SELECT *, close * shares AS cap, close * shares + coalesce(debt, 0) - coalesce(cash, 0) AS ev FROM vr)",
    "y AS (SELECT ticker, period_end, CASE WHEN net_income > 0 THEN cap / (net_income) END AS per, CASE WHEN equity > 0 THEN cap / (equity) END AS pbr, CASE WHEN revenue > 0 THEN cap / (revenue) END AS psr, CASE WHEN cfo > 0 THEN cap / (cfo) END AS pcr, CASE WHEN operating_income > 0 THEN cap / (operating_income) END AS por, CASE WHEN cfo - capex > 0 THEN cap / (cfo - capex) END AS pfcfr, ev AS ev, CASE WHEN operating_income > 0 THEN ev / (operating_income) END AS ev_ebit, CASE WHEN ebitda > 0 THEN ev / (ebitda) END AS ev_ebitda, CASE WHEN cap > 0 THEN (cfo - capex) / (cap) END AS fcf_yield, CASE WHEN cap > 0 THEN net_income / (cap) END AS earnings_yield, CASE WHEN cap > 0 THEN dividends / (cap) END AS dividend_yield, CASE WHEN shares > 0 THEN net_income / (shares) END AS eps, CASE WHEN shares > 0 THEN equity / (shares) END AS bps, CASE WHEN shares > 0 THEN revenue / (shares) END AS sps, CASE WHEN shares > 0 THEN operating_income / (shares) END AS ops, CASE WHEN shares > 0 THEN cfo / (shares) END AS oofps, CASE WHEN shares > 0 THEN (cfo - capex) / (shares) END AS fcfps, eps_raw FROM (SELECT *, CASE WHEN shares > 0 THEN net_income / shares END AS eps_raw FROM x))",
    twin="SELECT * EXCLUDE (eps_raw, b, g), per / CASE WHEN g > 0 THEN g END AS peg FROM (SELECT *, CASE WHEN b > 0 THEN eps_raw / b - 1 END AS g FROM (SELECT *, lag(eps_raw, 4) OVER (PARTITION BY ticker ORDER BY period_end) AS b FROM y))")
def per_share_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All market ratios and values per share at each period's end, with missing debts and tickers without shares."""
    rows = ad.statements(spark, sf_dir).withColumns({
        "debt": F.when(F.col("fiscal_quarter") != 3, F.col("debt")), "shares": F.when(F.col("ticker") % 11 == 0, 0.0).otherwise(F.col("shares")), "ebitda": F.col("operating_income") + F.col("n_lines") * 50, "dividends": F.col("interest"),
    })
    priced = asof.at_period_end(rows, ad.prices(spark, sf_dir), ["ticker"], "period_end", "date", ["adj_close", "close"], "price")
    out = priced.select("ticker", "period_end", *(c.alias(n) for n, c in col.valuation_ratios("price").items()))
    before = F.lag("eps", 4).over(win.by("ticker", order="period_end"))
    growth = F.when(before > 0, F.col("eps") / before - 1)
    return out.withColumn("peg", col.peg("per", growth))


@query(STATEMENTS, twin="""SELECT ticker, period_end, CASE WHEN equity > 0 THEN round(net_income / equity, 6) END AS roe, round(net_income / assets, 6) AS roa, round(operating_income * 0.79 / (equity + debt), 6) AS roic, round((revenue - cogs) / assets, 6) AS gp_a,
 round((revenue - cogs) / revenue, 6) AS gross_margin, round(operating_income / revenue, 6) AS operating_margin, round(net_income / revenue, 6) AS net_margin, round((net_income - cfo) / assets, 6) AS accruals, CASE WHEN equity > 0 THEN round(debt / equity, 6) END AS leverage, CASE WHEN net_income > 0 THEN round(cfo / net_income, 6) END AS ccr FROM stmts""")
def quality_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.statements(spark, sf_dir).select("ticker", "period_end", *(F.round(c, 6).alias(n) for n, c in col.quality_ratios().items()))


@query(STATEMENTS, twin="""SELECT ticker, period_end, round(receivables / revenue * 365, 5) AS dso, round(inventory / cogs * 365, 5) AS dio, round(payables / cogs * 365, 5) AS dpo, round(receivables / revenue * 365 + inventory / cogs * 365, 5) AS operating_cycle, round(receivables / revenue * 365 + inventory / cogs * 365 - payables / cogs * 365, 5) AS cash_cycle FROM stmts""")
def cash_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.statements(spark, sf_dir).select("ticker", "period_end", *(F.round(c, 5).alias(n) for n, c in col.cash_cycle().items()))


@query(BARS, STATEMENTS, _KNOWN, _PANEL, f"""x AS (SELECT *, net_income_ttm / assets AS ro, debt / assets AS le, cash / debt AS ca, (revenue_ttm - cogs_ttm) / revenue_ttm AS ma, revenue_ttm / assets AS tu FROM panel)""", twin=f"""SELECT ticker, date,
 coalesce(CAST(ro > 0 AS INTEGER), 0) + coalesce(CAST(cfo_ttm > 0 AS INTEGER), 0) + coalesce(CAST(ro > lag(ro, 252) OVER w AS INTEGER), 0) + coalesce(CAST(cfo_ttm > net_income_ttm AS INTEGER), 0) + coalesce(CAST(le < lag(le, 252) OVER w AS INTEGER), 0)
 + coalesce(CAST(ca > lag(ca, 252) OVER w AS INTEGER), 0) + coalesce(CAST(shares <= lag(shares, 252) OVER w AS INTEGER), 0) + coalesce(CAST(ma > lag(ma, 252) OVER w AS INTEGER), 0) + coalesce(CAST(tu > lag(tu, 252) OVER w AS INTEGER), 0) AS f_score FROM x WINDOW w AS ({_W})""")
def piotroski(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.with_piotroski(_panel(spark, sf_dir)).select("ticker", "date", "f_score")


@query(BARS, twin="""SELECT ticker, date, close, rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2 AS rank_asc, rank() OVER (PARTITION BY date ORDER BY close DESC) + (count(*) OVER (PARTITION BY date, close) - 1) / 2 AS rank_desc,
 round((rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2) / count(*) OVER (PARTITION BY date), 6) AS pct, round(CASE WHEN stddev_samp(close) OVER (PARTITION BY date) = 0 THEN 0 ELSE (close - avg(close) OVER (PARTITION BY date)) / stddev_samp(close) OVER (PARTITION BY date) END, 5) AS z FROM bars""")
def xs_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screen.rank_columns(ad.prices(spark, sf_dir).select("ticker", "date", "close"), "close")
    return out.withColumns({"pct": F.round("pct", 6), "z": F.round("z", 5)})


@query(BARS, twin="""SELECT b.ticker, b.date, round(least(greatest(close, q.lo), q.hi), 6) AS close FROM bars b JOIN (SELECT date, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi FROM bars GROUP BY date) q ON b.date = q.date""")
def winsor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(screen.winsorised(ad.prices(spark, sf_dir).select("ticker", "date", "close"), ["close"], 0.05, 0.95))


_RULE = "per > 0 AND dollar_volume_20d > 1000000"


@query(BARS, STATEMENTS, _KNOWN, _PANEL, """sec AS (SELECT p.ticker, p.date, net_income_ttm / (close * shares) AS ey, m126 FROM panel p JOIN (SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date)) d ON p.date = d.date
 WHERE net_income_ttm > 0 AND close * shares / net_income_ttm > 0 AND dv > 1000000)""", """pct AS (SELECT ticker, date, (rank() OVER (PARTITION BY date ORDER BY ey) + (count(*) OVER (PARTITION BY date, ey) - 1) / 2) / count(ey) OVER (PARTITION BY date) * 100 AS a,
 CASE WHEN m126 IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY m126 NULLS LAST) + (count(*) OVER (PARTITION BY date, m126) - 1) / 2) / count(m126) OVER (PARTITION BY date) * 100 END AS b FROM sec)""",
    """sc AS (SELECT ticker, date, (a * 0.6 + coalesce(b * 0.4, 0)) / (CASE WHEN b IS NULL THEN 0.6 ELSE 0.6 + 0.4 END) AS score FROM pct)""", twin="""SELECT ticker, date, round(score, 5) AS score, rank, round(least(0.15, 1 / count(*) OVER (PARTITION BY date)), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC, ticker) AS rank FROM sc) WHERE rank <= 10""")
def screen_topn_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: at each month's end the ten best by 60 % earnings yield and 40 % six-month momentum, and their weights."""
    panel = _panel(spark, sf_dir, "per", "earnings_yield", "dollar_volume_20d", "momentum_126")
    dates = screen.rebalance_dates(panel, "month")
    section = panel.join(dates, "date", "left_semi").where(screen.rule(_RULE))
    scored = screen.scored(section, {"earnings_yield": (0.6, True), "momentum_126": (0.4, True)}).withColumn("score", F.round("score", 9))
    best = screen.ranked(scored).where("rank <= 10")
    return screen.weighted(best, cap=0.15).select("ticker", "date", F.round("score", 5).alias("score"), "rank", F.round("weight", 6).alias("weight"))


@query(BARS, twin="""SELECT ticker, date, close > 100000 AS a, volume >= 20 AS b, close > open AS c, (close > 100000 AND volume >= 20) OR close > open AS selected,
 array_to_string(list_filter([CASE WHEN close > 100000 THEN 'a' END, CASE WHEN volume >= 20 THEN 'b' END, CASE WHEN close > open THEN 'c' END], lambda x: x IS NOT NULL), ',') AS passed,
 array_to_string(list_filter([CASE WHEN close <= 100000 THEN 'a' END, CASE WHEN volume < 20 THEN 'b' END, CASE WHEN close <= open THEN 'c' END], lambda x: x IS NOT NULL), ',') AS failed FROM bars""")
def condition_set_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screen.with_conditions(ad.prices(spark, sf_dir), {"a": "close > 100000", "b": "volume >= 20", "c": "close > open"}, "(a AND b) OR c")
    return out.select("ticker", "date", "a", "b", "c", "selected", F.array_join("passed", ",").alias("passed"), F.array_join("failed", ",").alias("failed"))


_MASTER = "master AS (SELECT s_suppkey AS ticker, s_name AS name, n_name AS nation, r_name AS region, s_acctbal * 1e7 AS market_cap FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"


@query(BARS, _MASTER, twin="SELECT m.ticker, name, region, market_cap FROM master m WHERE market_cap >= 3e8 AND market_cap < 200e9 AND region <> 'AFRICA' AND ticker IN (SELECT ticker FROM bars WHERE close > 150000) AND ticker NOT IN (SELECT ticker FROM bars WHERE volume > 140)")
def universe_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = ad.prices(spark, sf_dir)
    out = screen.universe(ad.master(spark, sf_dir).withColumn("sector", F.col("region")), include=prices.where("close > 150000"), exclude=prices.where("volume > 140"), least_cap=3e8, buckets=("large", "mid", "small"), not_sectors=("AFRICA",))
    return out.select("ticker", "name", "region", "market_cap")


@query(_MASTER, twin="SELECT ticker, CASE WHEN market_cap >= 200e9 THEN 'mega' WHEN market_cap >= 10e9 THEN 'large' WHEN market_cap >= 2e9 THEN 'mid' WHEN market_cap >= 300e6 THEN 'small' ELSE 'micro' END AS bucket FROM master")
def size_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.master(spark, sf_dir).select("ticker", col.size_bucket("market_cap").alias("bucket"))


@query(BARS, STATEMENTS, twin="""SELECT ticker, market_cap, row_number() OVER (ORDER BY market_cap DESC, ticker) AS rank FROM (SELECT b.ticker, close * (SELECT arg_max(shares, period_end) FROM stmts s WHERE s.ticker = b.ticker AND shares > 0) AS market_cap FROM bars b WHERE date = (SELECT max(date) FROM bars))
 WHERE market_cap > 0 AND market_cap <= 1e13 ORDER BY market_cap DESC, ticker LIMIT 20""")
def topn_market_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.top_by_market_cap(ad.prices(spark, sf_dir), ad.statements(spark, sf_dir), 20)


@query(BARS, twin="SELECT DISTINCT max(date) OVER (PARTITION BY date_trunc('week', date)) AS date FROM bars")
def rebalance_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.rebalance_dates(ad.prices(spark, sf_dir), "week")


@query(BARS, STATEMENTS, twin="SELECT s.ticker, s.period_end, s.available_date, (SELECT min(date) FROM bars b WHERE b.date > s.available_date) AS next_day FROM stmts s")
def next_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ad.statements(spark, sf_dir).select("ticker", "period_end", "available_date")
    return asof.next_row(left, ad.prices(spark, sf_dir), "available_date", "date", "next_day")


@query(BARS, "days AS (SELECT date, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS last FROM (SELECT DISTINCT date FROM bars))", twin="SELECT s.date AS signal_date, t.date AS exec_date FROM (SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date)) m JOIN days s ON s.date = m.date JOIN days t ON t.n = least(s.n + 1, s.last)")
def exec_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = ad.prices(spark, sf_dir)
    return screen.execution_days(screen.rebalance_dates(prices, "month"), prices)


@query(BARS, "m AS (SELECT max(date) AS d, lead(max(date)) OVER (ORDER BY max(date)) AS nxt FROM bars GROUP BY date_trunc('quarter', date))", """w AS (SELECT m.d AS exec_date, m.nxt AS next_date, ticker, 1.0 / count(*) OVER (PARTITION BY m.d) AS weight, close AS p0 FROM m JOIN bars ON date = m.d WHERE nxt IS NOT NULL)""",
    "v AS (SELECT exec_date, date, sum(weight * (close / p0 - 1)) + 1 AS value FROM w JOIN bars b ON b.ticker = w.ticker AND b.date >= exec_date AND b.date <= next_date GROUP BY exec_date, date)",
    "e AS (SELECT exec_date, arg_max(value, date) AS last FROM v GROUP BY exec_date)", twin="SELECT v.exec_date, v.date, round(v.value, 6) AS value, round(v.value * coalesce((SELECT product(e.last) FROM e WHERE e.exec_date < v.exec_date), 1), 5) AS curve FROM v")
def portfolio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    prices = ad.prices(spark, sf_dir)
    dates = screen.rebalance_dates(prices, "quarter").withColumnRenamed("date", "exec_date")
    dates = dates.withColumn("next_date", F.lead("exec_date").over(Window.partitionBy(F.lit(0)).orderBy("exec_date"))).where("next_date IS NOT NULL")
    held = screen.weighted(prices.join(dates, F.col("date") == F.col("exec_date")), keys=["exec_date"]).select("exec_date", "next_date", "ticker", "weight")
    return perf.held_returns(held, prices).withColumns({"value": F.round("value", 6), "curve": F.round("curve", 5)})


@query(BARS, twin="SELECT ticker, round(quantile_cont(close, 0.1), 3) AS q10, round(quantile_cont(close, 0.5), 3) AS q50, round(quantile_cont(close, 0.9), 3) AS q90 FROM bars WHERE close > 0 GROUP BY ticker")
def quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(quality.quantiles(ad.prices(spark, sf_dir), ["ticker"], "close", (0.1, 0.5, 0.9)), 3)


@query(BARS, "s AS (SELECT year(date) AS year, ticker, sum(volume) AS volume FROM bars GROUP BY 1, 2)", twin="SELECT year, CASE WHEN n <= 5 THEN CAST(ticker AS VARCHAR) ELSE 'others' END AS ticker, sum(volume) AS volume FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY abs(volume) DESC, ticker) AS n FROM s) GROUP BY 1, 2 HAVING max(n) <= 5 OR sum(volume) <> 0")
def topn_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = ad.prices(spark, sf_dir).groupBy(F.year("date").alias("year"), "ticker").agg(F.sum("volume").alias("volume"))
    return quality.top_with_others(yearly, ["year"], "ticker", "volume", 5)


@query(BARS, twin="SELECT ticker, count(*) OVER (PARTITION BY ticker) AS n, date, close FROM bars")
def nested_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = io.nested(ad.prices(spark, sf_dir), "ticker", "date", ["close"])
    rows = io.flat(own, "ticker", "date", ["close"]).join(own.select("ticker", F.size("date").cast("long").alias("n")), "ticker")
    return rows.select("ticker", "n", "date", "close")


@query(STATEMENTS, twin="""SELECT ticker, period_end, round((revenue / lag(revenue, 4) OVER w - 1) * 100, 5) AS revenue_growth, (SELECT CASE WHEN p.net_income <> 0 THEN round((s.net_income / p.net_income - 1) * 100, 4) END FROM stmts p WHERE p.ticker = s.ticker AND p.fiscal_year * 4 + p.fiscal_quarter = s.fiscal_year * 4 + s.fiscal_quarter - 4) AS income_growth
 FROM stmts s WINDOW w AS (PARTITION BY ticker ORDER BY period_end)""")
def growth_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir).withColumn("k", col.fiscal_key("fiscal_year", "fiscal_quarter"))
    return rows.select("ticker", "period_end", F.round(win.growth("revenue", win.by("ticker", order="period_end"), 4), 5).alias("revenue_growth"), F.round(win.growth_by_key("net_income", ["ticker"], "k", 4), 4).alias("income_growth"))


@query(STATEMENTS, twin="""SELECT * FROM (SELECT ticker, period_end, available_date, 'quarter' AS basis, CASE WHEN equity > 0 THEN round(net_income / equity, 6) END AS roe, CASE WHEN revenue > 0 THEN round((revenue - cogs) / revenue, 6) END AS gross_margin FROM stmts
 UNION ALL SELECT ticker, period_end, available_date, 'ttm', CASE WHEN equity > 0 AND n = 4 THEN round(ni / equity, 6) END, CASE WHEN n = 4 AND r > 0 THEN round((r - c) / r, 6) END FROM (SELECT *, count(*) OVER w AS n, sum(net_income) OVER w AS ni, sum(revenue) OVER w AS r, sum(cogs) OVER w AS c FROM stmts WINDOW w AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
 UNION ALL SELECT ticker, make_date(year(period_end), 12, 31), max(available_date), 'annual', CASE WHEN arg_max(equity, period_end) > 0 THEN round(sum(net_income) / arg_max(equity, period_end), 6) END, CASE WHEN sum(revenue) > 0 THEN round((sum(revenue) - sum(cogs)) / sum(revenue), 6) END FROM stmts GROUP BY ticker, year(period_end))""")
def derived_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = {k: F.round(v, 6) for k, v in col.quality_ratios().items() if k in ("roe", "gross_margin")}
    return st.derived_factors(ad.statements(spark, sf_dir), ["net_income", "revenue", "cogs"], ["equity"], ratios)


@query(BARS, _RET, twin="""SELECT a.ticker, a.date, round(sum(a.ret - b.ret) OVER (PARTITION BY a.ticker ORDER BY a.date), 6) AS excess FROM ret a JOIN (SELECT ticker, date, 0.0001 AS ret FROM bars) b ON a.ticker = b.ticker AND a.date = b.date""")
def excess_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = perf.daily_returns(ad.prices(spark, sf_dir), ["ticker"], "close")
    flat = own.select("ticker", "date", F.lit(0.0001).alias("ret"), F.lit(1.0).alias("curve"))
    return perf.excess(own, flat, ["ticker"]).select("ticker", "date", F.round("excess", 6).alias("excess"))


