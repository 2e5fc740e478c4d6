"""Queries over row rules: rebuilt values, classifications, dates, policies and repairs.

Inputs are statements with gaps and faults put in by expressions that Spark and the SQL twins share; the rules are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as col
from ..functions import windows as win
from ..operators import asof, dedupe, facts, intervals, quality, reconcile, screen
from ..operators import statements as st
from ..sources import adapters as ad
from . import panel as pl
from .registry import BARS, STATEMENTS, query

_W = "WINDOW w AS (PARTITION BY ticker ORDER BY period_end)"


def _rows(spark: SparkSession, sf_dir: str, inputs: list[str]) -> DataFrame:
    return ad.statements(spark, sf_dir).selectExpr("ticker", "period_end", "fiscal_year", "fiscal_quarter", *inputs)


def _cte(inputs: list[str]) -> str:
    return f"x AS (SELECT ticker, period_end, fiscal_year, fiscal_quarter, {', '.join(inputs)} FROM stmts)"


def _reconciled(v: str, r: str) -> str:
    return f"(CASE WHEN {v} IS NULL OR (sign({v}) * sign({r}) < 0 AND abs(abs({v}) - abs({r})) <= 0.15 * greatest(abs({v}), abs({r}))) THEN {r} ELSE {v} END)"


_TOTALS = [
    "CASE WHEN fiscal_quarter = 1 THEN NULL ELSE revenue END AS rev", "cogs", "revenue - cogs AS gross", "net_income AS net", "CASE WHEN fiscal_quarter = 2 THEN NULL ELSE net_income + interest END AS pretax",
    "CASE WHEN fiscal_quarter = 3 THEN NULL ELSE interest END AS tax", "CASE WHEN fiscal_quarter = 2 THEN NULL ELSE assets END AS a", "CASE WHEN fiscal_quarter = 1 THEN NULL ELSE assets - equity END AS li",
    "CASE WHEN fiscal_quarter = 4 THEN -equity WHEN fiscal_quarter = 3 THEN NULL ELSE equity END AS e", "CASE fiscal_quarter WHEN 1 THEN NULL WHEN 2 THEN -operating_income ELSE operating_income END AS oi", "operating_income AS oi2",
]


@query(STATEMENTS, _cte(_TOTALS), twin=f"""SELECT ticker, period_end, coalesce(rev, cogs + gross) AS revenue, coalesce(pretax, net + tax) AS pretax, coalesce(tax, coalesce(pretax, net + tax) - net) AS tax, coalesce(a, li + e) AS assets, coalesce(li, a - e) AS liabilities,
 CASE WHEN abs(a - li - e) > 0.05 * abs(a) AND abs(a - li + e) <= 0.05 * abs(a) THEN -e ELSE coalesce(e, a - li) END AS equity, {_reconciled('oi', 'oi2')} AS operating_income FROM x""")
def rebuilt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, _TOTALS)
    filled = col.filled_totals("rev", "cogs", "gross", "pretax", "tax", "net")
    sheet = col.balance_identity("a", "li", "e")
    names = {"revenue": filled["rev"], "pretax": filled["pretax"], "tax": filled["tax"], "assets": sheet["a"], "liabilities": sheet["li"], "equity": sheet["e"], "operating_income": col.reconcile_signed("oi", "oi2")}
    return rows.select("ticker", "period_end", *(c.alias(n) for n, c in names.items()))


_GROSS = [
    "revenue", "cogs", "CASE WHEN fiscal_quarter = 1 THEN NULL WHEN fiscal_quarter = 2 THEN operating_income - 1 WHEN fiscal_quarter = 3 THEN cogs - revenue ELSE revenue - cogs END AS gross", "operating_income", "net_income", "interest", "opex", "capex", "payables",
    "CASE WHEN fiscal_quarter = 2 THEN shares * 3 WHEN fiscal_quarter = 3 THEN NULL ELSE shares * 1.1 END AS diluted", "CASE WHEN fiscal_quarter = 4 THEN NULL ELSE shares END AS basic", "shares", "CASE WHEN fiscal_quarter = 1 THEN net_income / 2 END AS reported",
]


@query(STATEMENTS, _cte(_GROSS), twin=f"""SELECT ticker, period_end, CASE WHEN gross < operating_income AND revenue - cogs >= operating_income AND revenue > 0 THEN revenue - cogs ELSE coalesce(gross, {_reconciled('gross', '(revenue - cogs)')}) END AS gross,
 round(coalesce(reported, CASE WHEN diluted / shares BETWEEN 0.5 AND 2 AND diluted > 0 THEN net_income / diluted END, CASE WHEN basic / shares BETWEEN 0.5 AND 2 AND basic > 0 THEN net_income / basic END), 6) AS eps,
 CASE WHEN reported IS NOT NULL THEN 'reported' WHEN diluted / shares BETWEEN 0.5 AND 2 THEN 'diluted' WHEN basic / shares BETWEEN 0.5 AND 2 THEN 'basic' END AS eps_source,
 abs(operating_income - (gross - opex)) <= abs(operating_income - (gross - opex - payables)) AS holds_both FROM x""")
def earnings_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = facts.eps_with_source("net_income", "diluted", "basic", "reported", "shares")
    return _rows(spark, sf_dir, _GROSS).select("ticker", "period_end", facts.gross_profit_proxy("revenue", "cogs", "gross", "operating_income").alias("gross_"), F.round(eps["eps"], 6).alias("eps"), eps["eps_source"].alias("eps_source"), col.split_by_fit("opex", "gross", "payables", "operating_income").alias("holds_both")).withColumnRenamed("gross_", "gross")


_DEBT = [
    "CASE WHEN fiscal_quarter = 1 THEN debt END AS tag", "CASE WHEN fiscal_quarter <= 2 THEN payables END AS lease", "CASE WHEN fiscal_quarter = 2 THEN inventory END AS p1", "CASE WHEN fiscal_quarter IN (2, 3) THEN receivables END AS p2", "equity AS base",
    "CASE WHEN fiscal_quarter = 3 THEN debt END AS nonc", "CASE WHEN fiscal_quarter IN (1, 3) THEN inventory END AS bundle", "CASE WHEN fiscal_quarter = 4 THEN NULL ELSE assets END AS tot", "capex AS ppe", "CASE WHEN fiscal_quarter = 1 THEN NULL ELSE payables END AS s1", "receivables AS s2", "CASE WHEN fiscal_quarter = 4 THEN interest END AS pr",
    "CASE WHEN fiscal_quarter = 1 THEN NULL WHEN fiscal_quarter = 2 THEN revenue * 0.05 ELSE cogs END AS direct", "CASE WHEN fiscal_quarter IN (1, 3) THEN NULL ELSE revenue - cogs END AS gp", "revenue AS rev", "revenue * 1.1 AS expenses", "CASE WHEN fiscal_quarter = 3 THEN opex END AS sga", "CASE WHEN fiscal_quarter = 2 THEN interest END AS sgb",
    "inventory AS dep", "CASE WHEN fiscal_quarter = 2 THEN NULL ELSE receivables END AS comb", "payables AS withc",
]
_ZERO = "CASE WHEN coalesce({0}) IS NOT NULL THEN {1} END"


def _sum(*cols: str) -> str:
    return _ZERO.format(", ".join(cols), " + ".join(f"coalesce({c}, 0)" for c in cols))


_LARGER = "(CASE WHEN {0} IS NULL OR {1} > {0} * {2} THEN {1} ELSE {0} END)"


@query(STATEMENTS, _cte(_DEBT), twin=f"""SELECT ticker, period_end, coalesce(CASE WHEN tag IS NOT NULL THEN {_sum('tag', 'lease')} END, {_sum('p1', 'p2')}, base) AS current_debt,
 {_sum('coalesce(nonc, bundle, tot, base)', 'lease', '(CASE WHEN nonc IS NULL AND bundle IS NOT NULL THEN NULL ELSE interest_ END)')} AS noncurrent_debt,
 {_sum('ppe', 'greatest(s1, s2)', 'pr')} AS capex, CASE WHEN (direct IS NULL AND gp IS NULL) OR (direct <= 0.1 * rev AND expenses > 1.02 * rev) THEN expenses ELSE coalesce(direct, rev - gp) END AS cost_of_sales,
 coalesce(sga, sgb, s1 + s2) AS selling, {_LARGER.format(_LARGER.format('dep', 'comb', 1.1), 'withc', 2.0)} AS depreciation FROM (SELECT *, ppe + 1 AS interest_ FROM x)""")
def rule_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, _DEBT).withColumn("interest_", F.col("ppe") + 1)
    shapes = {
        "current_debt": col.current_debt(["tag", "lease"], ["p1", "p2"], "base"), "noncurrent_debt": col.noncurrent_debt("nonc", "bundle", "tot", "base", "lease", "interest_"), "capex": col.capital_expenditure("ppe", ["s1", "s2"], ["pr"]),
        "cost_of_sales": col.cost_of_sales("direct", "gp", "rev", "expenses"), "selling": col.selling_expenses("sga", "sgb", "s1", "s2"), "depreciation": col.depreciation("dep", "comb", "withc"),
    }
    return rows.select("ticker", "period_end", *(c.alias(n) for n, c in shapes.items()))


_CHAIN = [
    "CASE fiscal_quarter WHEN 1 THEN NULL WHEN 2 THEN -operating_income ELSE operating_income END AS oi", "revenue AS rev", "CASE WHEN fiscal_quarter = 1 THEN revenue - operating_income END AS cost", "revenue - cogs AS gp", "opex AS ox",
    "CASE WHEN fiscal_quarter = 4 THEN opex END AS sga", "CAST(NULL AS DOUBLE) AS rnd", "ticker % 3 = 0 AS finance", "CASE WHEN fiscal_quarter = 3 THEN -net_income ELSE net_income END AS net", "CASE WHEN fiscal_quarter = 4 THEN NULL ELSE net_income + interest END AS pretax", "interest AS tax",
    "CASE WHEN ticker % 2 = 0 AND fiscal_quarter > 1 THEN NULL ELSE inventory END AS da", "inventory * 4 AS da_year", "CASE WHEN fiscal_quarter = 3 THEN -(receivables + payables) ELSE receivables + payables END AS aoci", "receivables AS part",
]


@query(STATEMENTS, _cte(_CHAIN),
    f"c1 AS (SELECT *, CASE WHEN finance THEN coalesce(oi, CASE WHEN coalesce(rev - cost <= 1.02 * gp, TRUE) THEN rev - cost END) ELSE coalesce({_reconciled('oi', '(CASE WHEN coalesce(rev - cost <= 1.02 * gp, TRUE) THEN rev - cost END)')}, oi) END AS o1 FROM x)",
    f"c2 AS (SELECT *, CASE WHEN finance THEN coalesce(o1, gp - ox) ELSE coalesce({_reconciled('o1', '(gp - ox)')}, o1) END AS o2 FROM c1)",
    f"c3 AS (SELECT *, CASE WHEN finance THEN coalesce(o2, gp - sga) ELSE coalesce({_reconciled('o2', '(gp - sga)')}, o2) END AS o3, coalesce({_reconciled('net', '(pretax - tax)')}, net) AS n1, avg(CAST(da IS NOT NULL AS INTEGER)) OVER (PARTITION BY ticker) AS have, avg(CAST(part > 0 AS INTEGER)) OVER (PARTITION BY ticker) AS pos FROM c2)",
    twin="""SELECT ticker, period_end, o3 AS operating_income, CASE WHEN rev <= 1e6 AND sign(pretax) * sign(n1) < 0 THEN -n1 ELSE n1 END AS net_income, CASE WHEN have < 0.4 THEN coalesce(da, da_year / 4) ELSE da END AS depreciation,
 CASE WHEN sign(aoci) = CASE WHEN pos >= 0.5 THEN 1 ELSE -1 END THEN aoci END AS other_income FROM c3""")
def rule_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = col.with_operating_income(_rows(spark, sf_dir, _CHAIN), "operating_income", "oi", "rev", "cost", "gp", "ox", "sga", "rnd", "finance")
    return rows.select("ticker", "period_end", "operating_income", col.net_income_chain("net", "pretax", "tax", "rev").alias("net_income"), col.by_coverage("da", "da_year").alias("depreciation"), facts.dominant_sign(F.col("aoci"), "part").alias("other_income"))


_NORMAL = ["CASE WHEN fiscal_quarter = 1 THEN revenue END AS v", "revenue", "cogs", "net_income", "interest AS tax", "CASE WHEN ticker % 2 = 0 THEN inventory END AS intangibles", "CASE WHEN ticker % 3 = 0 THEN payables END AS goodwill", "fiscal_quarter = 4 AS cash_flow_row", "fiscal_quarter >= 3 AS is_div"]


@query(STATEMENTS, _cte(_NORMAL), "m AS (SELECT * FROM x, (VALUES ('gross_profit'), ('pretax_income'), ('intangibles'), ('dividends')) t(metric))",
    twin="""SELECT ticker, period_end, metric, coalesce(v, CASE metric WHEN 'gross_profit' THEN revenue - cogs WHEN 'pretax_income' THEN net_income + tax WHEN 'intangibles' THEN CASE WHEN coalesce(intangibles, goodwill) IS NOT NULL THEN coalesce(intangibles, 0) + coalesce(goodwill, 0) END WHEN 'dividends' THEN CASE WHEN cash_flow_row THEN 0.0 END END) AS value,
 CASE WHEN v IS NOT NULL THEN 'reported' WHEN metric IN ('gross_profit', 'pretax_income') THEN 'rebuilt_' || metric WHEN metric = 'intangibles' AND coalesce(intangibles, goodwill) IS NOT NULL THEN 'rebuilt_intangibles' WHEN metric = 'dividends' AND cash_flow_row THEN 'no_dividend' END AS source FROM m""")
def normalised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, _NORMAL).withColumn("metric", F.explode(F.array(*map(F.lit, ("gross_profit", "pretax_income", "intangibles", "dividends")))))
    own = col.normalised_value("metric", {"value": "v", "revenue": "revenue", "cogs": "cogs", "net_income": "net_income", "tax": "tax", "intangibles": "intangibles", "goodwill": "goodwill", "cash_flow_row": "cash_flow_row"})
    return rows.withColumn("o", own).select("ticker", "period_end", "metric", F.col("o.value").alias("value"), F.col("o.source").alias("source"))


@query(STATEMENTS, twin=f"""SELECT ticker, period_end, (assets - coalesce(opex, 0)) AS net_assets, least(greatest(net_income, -1e5), 1e5) AS clipped, CAST(floor(log10(nullif(abs(net_income), 0))) AS INTEGER) AS magnitude, round(net_income - floor(net_income / nullif(-payables, 0)) * -payables, 4) AS rest,
 CASE WHEN period_end < DATE '1998-06-30' THEN 'before' ELSE 'after' END AS regime, CASE WHEN coalesce(opex, CASE WHEN fiscal_quarter = 1 THEN cash END) IS NOT NULL THEN coalesce(opex, 0) - coalesce(CASE WHEN fiscal_quarter = 1 THEN cash END, 0) END AS net_debt,
 coalesce(opex, interest) AS first_of, count(opex) OVER (PARTITION BY ticker) > 0 AS has_opex, CASE WHEN count(opex) OVER (PARTITION BY ticker, fiscal_year) > 0 THEN opex ELSE interest END AS first_column FROM stmts""")
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir)
    first_quarter = F.when(F.col("fiscal_quarter") == 1, F.col("cash"))
    return rows.select(
        "ticker", "period_end", col.both_or_null("assets", "opex").alias("net_assets"), col.clipped("net_income", -1e5, 1e5).alias("clipped"), col.magnitude("net_income").alias("magnitude"), F.round(col.remainder("net_income", -F.col("payables")), 4).alias("rest"),
        col.regime("period_end", "1998-06-30").alias("regime"), col.both_or_null("opex", first_quarter).alias("net_debt"), col.first_valid("opex", "interest").alias("first_of"), (F.count("opex").over(Window.partitionBy("ticker")) > 0).alias("has_opex"), col.first_valid_column(["ticker", "fiscal_year"], "opex", "interest").alias("first_column"),
    )


@query("d AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 AS INTEGER) END AS filed, CASE o_orderstatus WHEN 'O' THEN '10-K/A' WHEN 'F' THEN '10-Q' ELSE 'NT 10-K' END AS form FROM orders)",
    "q AS (SELECT *, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS qe, CAST(date_trunc('quarter', d) - INTERVAL 1 DAY AS DATE) AS qb FROM d)",
    twin="""SELECT k, qe AS quarter_end, CASE WHEN date_diff('day', qb, d) <= 15 THEN qb WHEN date_diff('day', d, qe) <= 15 THEN qe ELSE d END AS snapped, d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS next_weekday,
 ends_with(form, '/A') AS is_amendment, starts_with(form, 'NT') AS is_nt, date_diff('day', qe, filed) AS lag_days, greatest(0.0, least(100.0, 100 - 2 * abs(date_diff('day', qe, filed) - CASE WHEN starts_with(form, '10-K') THEN 90 ELSE 45 END))) AS punctuality FROM q""".replace("greatest(0.0, least(100.0,", "CASE WHEN filed IS NOT NULL THEN greatest(0.0, least(100.0,").replace("END))) AS punctuality", "END))) END AS punctuality"))
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), "o_orderstatus", "o_custkey")
    rows = rows.withColumns({"filed": F.when(F.col("o_orderstatus") == "F", F.date_add("d", (F.col("o_custkey") % 120).cast("int"))), "form": F.when(F.col("o_orderstatus") == "O", "10-K/A").when(F.col("o_orderstatus") == "F", "10-Q").otherwise("NT 10-K")})
    lag, flags = F.datediff("filed", col.quarter_end("d")), col.form_flags("form")
    expected = F.when(F.col("form").startswith("10-K"), 90).otherwise(45)
    return rows.select("k", col.quarter_end("d").alias("quarter_end"), col.snap_quarter_end("d").alias("snapped"), col.next_weekday("d").alias("next_weekday"), flags["is_amendment"].alias("is_amendment"), flags["is_nt"].alias("is_nt"), lag.alias("lag_days"), F.when(F.col("filed").isNotNull(), col.punctuality(lag, expected)).alias("punctuality"))


_PARTS = "p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price, CASE p_size % 6 WHEN 0 THEN 'abcw' WHEN 1 THEN 'abc.ws' WHEN 2 THEN 'abcdw' WHEN 3 THEN 'xy-pa' ELSE 'xyz' END AS tk, CASE p_size % 5 WHEN 0 THEN 'New York Stock Exchange' WHEN 1 THEN 'Nasdaq GS' WHEN 2 THEN 'NYSE American' WHEN 3 THEN 'XETRA' END AS ex, CASE WHEN p_size % 4 = 0 THEN '6021' WHEN p_size % 4 = 1 THEN 'x' ELSE '3571' END AS sic FROM part)"


@query(_PARTS, twin="""SELECT k, NOT (regexp_matches(upper(tk), '(\\.|-)(W|WS|WT|U|UN|R|RT|P[A-Z]?)$|^[A-Z]{4}[WRU]$') OR regexp_matches(lower(name), '\\b(warrants?|units?|rights?|preferred|depositary|etf|fund|trust)\\b')) AS common, CASE upper(trim(kind)) WHEN 'ECONOMY' THEN 'ECO' WHEN 'PROMO' THEN 'PRM' ELSE upper(trim(kind)) END AS investor,
 CASE WHEN contains(upper(ex), 'NASDAQ') THEN 'NASDAQ' WHEN contains(upper(ex), 'AMERICAN') OR contains(upper(ex), 'AMEX') THEN 'AMEX' WHEN contains(upper(ex), 'NYSE') OR contains(upper(ex), 'NEW YORK') THEN 'NYSE' ELSE 'OTHER' END AS exchange,
 coalesce(TRY_CAST(sic AS INTEGER) BETWEEN 6000 AND 6799 OR regexp_matches(lower(name), '\\b(bank|bancorp|insurance|financial|capital|trust|reit)\\b'), FALSE) AS is_finance,
 CASE WHEN brand <> 'Brand#1' THEN price END AS shown, TRY_CAST(sic AS DOUBLE) AS sic_number, TRY_CAST(ex AS DATE) AS no_date, (price > 1000 AND size > 10) OR (size <= 5) AS grouped, size > 20 AS buy, NOT (size > 20) AS sell FROM p""")
def classification_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size")
    rows = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    rows = rows.withColumns({
        "tk": col.ladder([(size % 6 == 0, "abcw"), (size % 6 == 1, "abc.ws"), (size % 6 == 2, "abcdw"), (size % 6 == 3, "xy-pa")], "xyz"),
        "ex": col.ladder([(size % 5 == 0, "New York Stock Exchange"), (size % 5 == 1, "Nasdaq GS"), (size % 5 == 2, "NYSE American"), (size % 5 == 3, "XETRA")]),
        "sic": col.ladder([(size % 4 == 0, "6021"), (size % 4 == 1, "x")], "3571"),
    })
    traded = col.exchange_and_sector("ex", "sic", "name")
    buy, sell = screen.masks("size > 20")
    return rows.select(
        "k", col.common_stock(F.upper("tk"), "name").alias("common"), col.mapped("kind", {"economy": "ECO", "promo": "PRM"}).alias("investor"), traded["exchange"].alias("exchange"), traded["is_finance"].alias("is_finance"), col.hidden_for("brand", "Brand#1", "price")["price"].alias("shown"),
        col.to_double("sic").alias("sic_number"), col.to_date("ex").alias("no_date"), screen.grouped_filters([F.col("price") > 1000, size > 10], [size <= 5]).alias("grouped"), buy.alias("buy"), sell.alias("sell"),
    )


_ACCOUNTS = ["CASE WHEN ticker % 4 = 0 THEN 'Loss on sale' WHEN ticker % 4 = 1 THEN 'Gains, net' WHEN ticker % 4 = 2 THEN 'Gain or loss' ELSE 'Other' END AS account", "CASE WHEN fiscal_quarter = 1 THEN -interest ELSE interest END AS amount", "CASE WHEN fiscal_quarter = 2 THEN NULL ELSE cash END AS cur", "receivables AS raw", "payables AS conv",
    "CASE fiscal_quarter WHEN 1 THEN ' Thousand' WHEN 2 THEN 'm' WHEN 3 THEN '억' END AS unit", "revenue", "net_income", "equity"]


@query(STATEMENTS, _cte(_ACCOUNTS), twin="""SELECT ticker, period_end, CASE ticker % 4 WHEN 0 THEN -abs(amount) WHEN 1 THEN abs(amount) ELSE amount END AS amount, CASE WHEN cur - raw >= 0 AND cur - conv >= 0 THEN least(cur - raw, cur - conv) WHEN cur - raw >= 0 THEN cur - raw WHEN cur - conv >= 0 THEN cur - conv END AS baseline,
 CASE fiscal_quarter WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 WHEN 3 THEN 1e8 ELSE 1.0 END AS multiplier, concat_ws(',', CASE WHEN net_income < 0 THEN 'loss' END, CASE WHEN cur IS NULL THEN 'no_cash' END, CASE WHEN equity < 0 THEN 'negative_equity' END) AS codes FROM x""")
def account_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = col.codes({"loss": F.col("net_income") < 0, "no_cash": F.col("cur").isNull(), "negative_equity": F.col("equity") < 0})
    return _rows(spark, sf_dir, _ACCOUNTS).select("ticker", "period_end", col.account_sign("account", "amount").alias("amount"), col.smaller_change("cur", "raw", "conv").alias("baseline"), facts.unit_multiplier("unit").alias("multiplier"), F.array_join(found, ",").alias("codes"))


@query(BARS, "b AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before FROM bars)", twin="SELECT ticker, date, round(open * 1.001, 4) AS at_open, close AS at_close, round(before * 0.995, 4) AS at_signal FROM b")
def execution_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.prices(spark, sf_dir).withColumn("before", F.lag("close").over(win.by("ticker")))
    price = lambda kind, offset: col.execution_price("open", "close", "before", kind, offset)
    return rows.select("ticker", "date", F.round(price("open", 0.1), 4).alias("at_open"), price("close", 0.0).alias("at_close"), F.round(price("previous_close", -0.5), 4).alias("at_signal"))


_FAULTS = ["CASE WHEN fiscal_quarter = 3 AND ticker % 3 = 0 THEN revenue * 1000 WHEN fiscal_quarter = 2 AND ticker % 3 = 1 THEN revenue * 1000000 ELSE revenue END AS scaled", "CASE WHEN fiscal_quarter = 4 THEN revenue * 4 ELSE revenue END AS december", "CASE WHEN fiscal_quarter = 2 THEN revenue * 3 ELSE revenue END AS odd", "ticker % 2 = 0 AS votes"]
_NEAR = "((lag({0}) OVER w + lead({0}) OVER w) / 2)"


@query(STATEMENTS, _cte(_FAULTS), "y AS (SELECT *, sum(december) OVER (PARTITION BY ticker, year(period_end) ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM x)",
    twin=f"""SELECT ticker, period_end, CASE WHEN month(period_end) = 12 AND december > 1.2 * abs(earlier) AND december - earlier >= 0 THEN december - earlier ELSE december END AS quarter, round(CASE WHEN {_NEAR.format('odd')} <> 0 AND NOT odd / {_NEAR.format('odd')} BETWEEN 0.5 AND 2 THEN {_NEAR.format('odd')} ELSE odd END, 4) AS smoothed,
 round(CASE WHEN votes AND {_NEAR.format('scaled')} <> 0 AND scaled / {_NEAR.format('scaled')} BETWEEN 500 AND 2000 THEN scaled / 1e3 WHEN votes AND {_NEAR.format('scaled')} <> 0 AND scaled / {_NEAR.format('scaled')} BETWEEN 5e5 AND 2e6 THEN scaled / 1e6 ELSE scaled END, 4) AS rescaled FROM y {_W}""")
def value_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.by("ticker", order="period_end")
    rows = st.december_to_quarter(_rows(spark, sf_dir, _FAULTS), "december", "quarter")
    return rows.select("ticker", "period_end", "quarter", F.round(st.smooth_outlier("odd", w), 4).alias("smoothed"), F.round(st.scale_repair("scaled", w, F.col("votes")), 4).alias("rescaled"))


_EXPLAINED = "(n.s > 1 AND (abs(n.v / out - n.s) <= 0.25 * n.s OR abs(out / n.v - n.s) <= 0.25 * n.s))"
_FACTORS = ", ".join(map(str, st.SPLITS))


@query("RECURSIVE " + STATEMENTS, "n AS (SELECT ticker, period_end, row_number() OVER (PARTITION BY ticker ORDER BY period_end) AS n, CASE WHEN ticker % 4 = 0 AND fiscal_quarter = 3 THEN shares * 3 WHEN ticker % 4 = 1 AND fiscal_year >= 1998 THEN shares * 4 WHEN ticker % 4 = 2 AND fiscal_quarter = 2 THEN shares / 10 ELSE shares END AS v, CASE WHEN ticker % 4 = 1 AND fiscal_year = 1998 AND fiscal_quarter = 1 THEN 4.0 ELSE 1.0 END AS s FROM stmts)",
    f"""r AS (SELECT ticker, period_end, n, v AS out FROM n WHERE n = 1 UNION ALL SELECT n.ticker, n.period_end, n.n, CASE WHEN n.v / out BETWEEN 0.5 AND 2 OR {_EXPLAINED} THEN n.v
     ELSE coalesce(list_filter(list_transform([{_FACTORS}], lambda f: CASE WHEN abs(n.v / out - f) <= 0.12 * f THEN n.v / f WHEN abs(n.v / out - 1.0 / f) <= 0.12 / f THEN n.v * f END), lambda y: y IS NOT NULL)[1], n.v) END FROM r JOIN n ON n.ticker = r.ticker AND n.n = r.n + 1)""",
    twin="SELECT ticker, period_end, round(out, 4) AS shares FROM r")
def share_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q, y = F.col("ticker") % 4, F.col("fiscal_quarter"), F.col("fiscal_year")
    rows = ad.statements(spark, sf_dir).select("ticker", "period_end", F.when((k == 0) & (q == 3), F.col("shares") * 3).when((k == 1) & (y >= 1998), F.col("shares") * 4).when((k == 2) & (q == 2), F.col("shares") / 10).otherwise(F.col("shares")).alias("v"), F.when((k == 1) & (y == 1998) & (q == 1), 4.0).otherwise(1.0).alias("s"))
    own = rows.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("period_end", "v", "s"))).alias("r"))
    mended = own.select("ticker", F.explode(F.arrays_zip(F.col("r.period_end").alias("period_end"), st.mend_split_jumps(F.col("r.v"), F.col("r.s")).alias("shares"))).alias("o"))
    return mended.select("ticker", "o.period_end", F.round("o.shares", 4).alias("shares"))


_TRUST = ["receivables / revenue AS steady", "n_lines", "CASE WHEN fiscal_quarter = 1 THEN 'xbrl' WHEN fiscal_quarter = 2 THEN 'table' ELSE 'text' END AS origin", "CASE WHEN ticker % 3 = 0 THEN 'poor' WHEN ticker % 3 = 1 THEN 'sparse' ELSE 'good' END AS cluster"]


@query(STATEMENTS, _cte(_TRUST), "s AS (SELECT *, greatest(0, least(CASE origin WHEN 'xbrl' THEN 55 WHEN 'table' THEN 38 ELSE 20 END + least(50, CAST(floor(n_lines) AS INTEGER) * 3) + CASE WHEN steady > 0.05 THEN 10 ELSE 0 END, CASE cluster WHEN 'poor' THEN 25 WHEN 'sparse' THEN 35 ELSE 100 END, 100)) AS score FROM x)",
    twin="SELECT ticker, period_end, score, CASE WHEN score >= 90 THEN 'very_high' WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score >= 25 THEN 'low' ELSE 'very_low' END AS band, CASE WHEN cluster = 'poor' THEN 'collect' WHEN score < 50 THEN 'review' ELSE 'accept' END AS lane, CASE WHEN cluster = 'poor' THEN 1 WHEN score < 50 THEN 2 ELSE 3 END AS priority FROM s")
def source_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin, cluster = F.col("origin"), F.col("cluster")
    base = F.when(origin == "xbrl", 55).when(origin == "table", 38).otherwise(20)
    points = [F.least(F.lit(50), F.floor("n_lines").cast("int") * 3), F.when(F.col("steady") > 0.05, 10).otherwise(0)]
    cap = F.when(cluster == "poor", 25).when(cluster == "sparse", 35).otherwise(100)
    rows = _rows(spark, sf_dir, _TRUST).withColumn("score", reconcile.confidence(base, points, cap))
    lane = reconcile.recovery([(cluster == "poor", "collect", 1), (F.col("score") < 50, "review", 2)], ("accept", 3))
    return rows.select("ticker", "period_end", "score", reconcile.band("score").alias("band"), lane["lane"].alias("lane"), lane["priority"].alias("priority"))


@query(STATEMENTS, twin="SELECT fiscal_year, fiscal_quarter, count(*) AS n, count_if(filing_date > period_end + 60) AS late, CASE WHEN count_if(filing_date > period_end + 75) > 0 THEN 'fail' WHEN count_if(filing_date > period_end + 60) > 0 THEN 'warn' ELSE 'pass' END AS status, bool_and(filing_date <= period_end + 79) AS ok FROM stmts GROUP BY 1, 2")
def look_ahead_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screen.without_look_ahead(ad.statements(spark, sf_dir).withColumn("signal", F.date_add("period_end", 79)), "signal", ["filing_date", "available_date"])
    out = rows.groupBy("fiscal_year", "fiscal_quarter").agg(F.count("*").alias("n"), F.count_if(F.col("filing_date") > F.date_add("period_end", 60)).alias("late"), F.count_if(F.col("filing_date") > F.date_add("period_end", 75)).alias("__f"), F.bool_and("look_ahead_ok").alias("ok"))
    return out.select("fiscal_year", "fiscal_quarter", "n", "late", quality.status(F.col("__f"), F.col("late")).alias("status"), "ok")


@query(STATEMENTS, twin="""SELECT ticker, period_end, fiscal_year || 'Q' || fiscal_quarter AS label, fiscal_year AS label_year, fiscal_quarter AS label_quarter, 'A' || ticker || 'B' AS key, lpad(CAST(ticker AS VARCHAR), 6, '0') AS padded, sha1(ticker || '|' || CAST(period_end AS VARCHAR) || '|' || form) AS id,
 coalesce(opex, CASE WHEN fiscal_quarter = 1 THEN interest + payables END, revenue - cogs) AS combined FROM stmts""")
def key_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir)
    label = col.fiscal_label("fiscal_year", "fiscal_quarter")
    parsed = col.parse_fiscal_label(label)
    first = lambda c: F.when(F.col("fiscal_quarter") == 1, F.col(c))
    return rows.select(
        "ticker", "period_end", label.alias("label"), parsed["year"].alias("label_year"), parsed["quarter"].alias("label_quarter"), col.ticker_key(F.concat(F.lit(" a."), F.col("ticker").cast("string"), F.lit("-b"))).alias("key"), col.padded_ticker("ticker").alias("padded"),
        col.row_id("ticker", "period_end", "form").alias("id"), col.combine(["opex"], [first("interest"), first("payables")], "revenue", "cogs").alias("combined"),
    )


@query(STATEMENTS, BARS, f"g AS (SELECT ticker, period_end, revenue, (revenue / lag(revenue, 4) OVER w - 1) * 100 AS g FROM stmts {_W})", "c AS (SELECT ticker, date, CASE WHEN count(close) OVER a >= 5 THEN avg(close) OVER a END AS f, CASE WHEN count(close) OVER b >= 12 THEN avg(close) OVER b END AS s FROM bars WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING))",
    twin="SELECT g.ticker, g.period_end, g.revenue, round(g.g, 6) AS revenue_growth, coalesce(c.f > c.s, FALSE) AS above FROM g ASOF LEFT JOIN c ON c.ticker = g.ticker AND g.period_end >= c.date")
def growth_and_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ad.prices(spark, sf_dir).select("ticker", "date", pl.moving_average_cross("close", 20, 50).alias("above"))
    both = asof.asof_columns(pl.statement_growth(ad.statements(spark, sf_dir), ["revenue"]), flags, ["ticker"], "period_end", "date", ["above"])
    return both.select("ticker", "period_end", "revenue", F.round("revenue_growth", 6).alias("revenue_growth"), F.coalesce("above", F.lit(False)).alias("above"))


@query("e AS (SELECT o_custkey AS ticker, o_custkey + 10000 AS ticker_new, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'P' THEN 'rename' WHEN 'O' THEN 'add' ELSE 'remove' END AS action, o_orderkey AS event_id FROM orders)",
    twin="SELECT ticker, date, action, event_id FROM e WHERE action <> 'rename' UNION ALL SELECT ticker, date, 'remove', event_id FROM e WHERE action = 'rename' UNION ALL SELECT ticker_new, date, 'add', event_id FROM e WHERE action = 'rename'")
def expanded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), (F.col("o_custkey") + 10000).alias("ticker_new"), F.col("o_orderdate").cast("date").alias("date"), F.when(status == "P", "rename").when(status == "O", "add").otherwise("remove").alias("action"), F.col("o_orderkey").alias("event_id"))
    return intervals.expand_events(rows).select("ticker", "date", "action", "event_id")


@query(STATEMENTS, "c AS (SELECT ticker, period_end, revenue, cogs * 2 AS other, abs(revenue - cogs * 2) / abs(revenue) AS pct FROM stmts)", twin="SELECT ticker, period_end, round(pct, 6) AS pct_diff FROM c WHERE pct > 0.05 ORDER BY pct DESC, ticker, period_end LIMIT 25")
def top_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = col.pct_diff("revenue", F.col("cogs") * 2)
    rows = ad.statements(spark, sf_dir).withColumns({"pct_diff": pct, "breached": pct > 0.05})
    return reconcile.top_breaches(rows, 25, "ticker", "period_end").select("ticker", "period_end", F.round("pct_diff", 6).alias("pct_diff"))


@query(twin="SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.top_n(ad.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), "c_custkey"], 40)
