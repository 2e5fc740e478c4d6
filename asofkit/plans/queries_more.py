"""Further queries: facts, matching, trends, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows as win
from ..operators import asof, dedupe, facts, perf, quality, reconcile, screen
from ..operators import statements as st
from ..sources import adapters as ad
from .queries_records import _FACTS, _OTHER
from .registry import BARS, STATEMENTS, query

_W = "PARTITION BY ticker ORDER BY date"


@query(BARS, twin=f"""SELECT ticker, date, CAST(coalesce(close > s200, FALSE) AS DOUBLE) AS above, CAST(coalesce(s50 > s200, FALSE) AS DOUBLE) AS golden, round(close / s200 - 1, 6) AS gap FROM (
 SELECT ticker, date, close, CASE WHEN count(close) OVER a >= 50 THEN avg(close) OVER a END AS s200, CASE WHEN count(close) OVER b >= 12 THEN avg(close) OVER b END AS s50 FROM bars WINDOW a AS ({_W} ROWS 199 PRECEDING), b AS ({_W} ROWS 49 PRECEDING))""")
def trend_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.by("ticker")
    rows = ad.prices(spark, sf_dir).withColumns({"s200": win.sma("close", w, 200), "s50": win.sma("close", w, 50)})
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return rows.select("ticker", "date", flag(F.col("close") > F.col("s200")).alias("above"), flag(F.col("s50") > F.col("s200")).alias("golden"), F.round(F.col("close") / F.col("s200") - 1, 6).alias("gap"))


@query(BARS, twin="""SELECT ticker, date, round(sum(CASE WHEN day(date) <= 7 THEN 1000 / close ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date) * close, 4) AS equity FROM bars""")
def benchmark_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = ad.prices(spark, sf_dir).select("ticker", "date", "close")
    flows = prices.where(F.dayofmonth("date") <= 7).select("ticker", "date", F.lit(1000.0).alias("flow"))
    return perf.benchmark_units(prices, flows, ["ticker"]).select("ticker", "date", F.round("equity", 4).alias("equity"))


@query(STATEMENTS, twin="""SELECT ticker, period_end, CASE WHEN net_income / revenue >= 0 THEN round(net_income / 1000.0 * 12, 4) END AS x, (receivables - lag(receivables) OVER w) + (inventory - lag(inventory) OVER w) - (payables - lag(payables) OVER w) AS wc_change, (equity + lag(equity) OVER w) / 2 AS avg_equity FROM stmts WINDOW w AS (PARTITION BY ticker ORDER BY period_end)""")
def balance_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.by("ticker", order="period_end")
    return ad.statements(spark, sf_dir).select("ticker", "period_end", F.when(F.col("net_income") / F.col("revenue") >= 0, F.round(F.col("net_income") / 1000.0 * 12, 4)).alias("x"), st.working_capital_change(w).alias("wc_change"), st.average_balance("equity", w).alias("avg_equity"))


@query(STATEMENTS, "ly AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS n FROM stmts)", twin="SELECT ticker, period_end, revenue FROM ly WHERE n <= 8")
def last_two_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.last_years(ad.statements(spark, sf_dir), 2).select("ticker", "period_end", "revenue")


@query(STATEMENTS, """x AS (SELECT ticker, period_end, fiscal_quarter AS fq, CASE WHEN ticker % 5 = 0 AND fiscal_quarter = 4 THEN revenue * 4 WHEN ticker % 11 = 3 AND fiscal_quarter = 2 THEN revenue * 1000 ELSE revenue END AS v FROM stmts)""",
    """n AS (SELECT *, list_sort(list_filter([CASE WHEN lag(fq, 1) OVER w <> 4 THEN lag(v, 1) OVER w END, CASE WHEN lag(fq, 2) OVER w <> 4 THEN lag(v, 2) OVER w END, CASE WHEN lag(fq, 3) OVER w <> 4 THEN lag(v, 3) OVER w END, CASE WHEN lead(fq, 1) OVER w <> 4 THEN lead(v, 1) OVER w END, CASE WHEN lead(fq, 2) OVER w <> 4 THEN lead(v, 2) OVER w END, CASE WHEN lead(fq, 3) OVER w <> 4 THEN lead(v, 3) OVER w END], lambda q: q > 0)) AS l,
     lag(v, 1) OVER w + lag(v, 2) OVER w + lag(v, 3) OVER w AS three FROM x WINDOW w AS (PARTITION BY ticker ORDER BY period_end))""", "m AS (SELECT *, CASE WHEN len(l) > 0 THEN (l[CAST(floor((len(l) - 1) / 2) AS INTEGER) + 1] + l[CAST(floor(len(l) / 2) AS INTEGER) + 1]) / 2 END AS m FROM n)",
    twin="""SELECT ticker, period_end, round(CASE WHEN v < 0 THEN NULL WHEN fq = 4 AND v >= 2.8 * m AND v < 20 * m THEN CASE WHEN (v - three) / m BETWEEN 0.1 AND 4 THEN v - three END WHEN v >= 20 * m THEN CASE WHEN v / 1e3 / m BETWEEN 0.2 AND 5 THEN v / 1e3 WHEN v / 1e6 / m BETWEEN 0.2 AND 5 THEN v / 1e6 END ELSE v END, 3) AS revenue FROM m""")
def anomalies_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir).withColumn("v", F.when((F.col("ticker") % 5 == 0) & (F.col("fiscal_quarter") == 4), F.col("revenue") * 4).when((F.col("ticker") % 11 == 3) & (F.col("fiscal_quarter") == 2), F.col("revenue") * 1000).otherwise(F.col("revenue")))
    return facts.anomalies_mended(rows, "v", "mended").select("ticker", "period_end", F.round("mended", 3).alias("revenue"))


@query(STATEMENTS, "yt AS (SELECT ticker, fiscal_year, fiscal_quarter, CASE WHEN ticker % 2 = 0 THEN sum(revenue) OVER (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter) ELSE revenue END AS x FROM stmts)",
    "y AS (SELECT ticker, fiscal_year, max(CASE WHEN fiscal_quarter = 1 THEN x END) AS a, max(CASE WHEN fiscal_quarter = 2 THEN x END) AS b, max(CASE WHEN fiscal_quarter = 3 THEN x END) AS c, max(CASE WHEN fiscal_quarter = 4 THEN x END) AS d FROM yt GROUP BY 1, 2)",
    "z AS (SELECT *, CASE WHEN d > coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AND coalesce(a, b, c) IS NOT NULL THEN d - (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) ELSE d END AS dd FROM y)",
    "p AS (SELECT *, coalesce(CAST(b - a < 0 AS INTEGER), 0) + coalesce(CAST(c - b < 0 AS INTEGER), 0) + coalesce(CAST(d - c < 0 AS INTEGER), 0) + coalesce(CAST(a < 0 AS INTEGER), 0) + coalesce(CAST(abs(d - c) > 3 * greatest(abs(a), abs(b - a), abs(c - b)) AS INTEGER), 0) AS pr, coalesce(CAST(dd < 0 AS INTEGER), 0) + coalesce(CAST(a < 0 AS INTEGER), 0) + coalesce(CAST(b < 0 AS INTEGER), 0) + coalesce(CAST(c < 0 AS INTEGER), 0) + coalesce(CAST(abs(dd) > 3 * greatest(abs(a), abs(b), abs(c)) AS INTEGER), 0) AS pd FROM z)",
    twin="SELECT ticker, fiscal_year, a AS q1, CASE WHEN pr < pd THEN b - a ELSE b END AS q2, CASE WHEN pr < pd THEN c - b ELSE c END AS q3, CASE WHEN pr < pd THEN d - c ELSE dd END AS q4, CASE WHEN pr < pd THEN 'running' ELSE 'direct' END AS mode FROM p")
def two_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.by("ticker", "fiscal_year", order="fiscal_quarter")
    rows = ad.statements(spark, sf_dir).withColumn("x", F.when(F.col("ticker") % 2 == 0, F.sum("revenue").over(w)).otherwise(F.col("revenue")))
    return facts.two_hypotheses(rows, "x")


@query(STATEMENTS, "a AS (SELECT ticker, period_end, fiscal_quarter = 2 AS an FROM stmts)", "b AS (SELECT *, min(CASE WHEN an THEN period_end END) OVER (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx, max(CASE WHEN an THEN period_end END) OVER (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM a)",
    "k AS (SELECT ticker, period_end, coalesce(year(nx) * 4 + 4 - CAST(round(date_diff('day', period_end, nx) / 91.0) AS INTEGER), year(pv) * 4 + 4 + CAST(round(date_diff('day', pv, period_end) / 91.0) AS INTEGER), year(period_end) * 4 + quarter(period_end)) AS k FROM b)",
    twin="SELECT ticker, period_end, CAST(floor((k - 1) / 4) AS INTEGER) AS fiscal_year, CAST((k - 1) % 4 + 1 AS INTEGER) AS fiscal_quarter FROM k")
def fiscal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir).select("ticker", "period_end", (F.col("fiscal_quarter") == 2).alias("is_annual"))
    return facts.fiscal_labels(rows).drop("is_annual")


@query(STATEMENTS, """f AS (SELECT ticker, make_date(fiscal_year, 1, 1) AS s, period_end AS e, sum(revenue) OVER (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter) AS v, filing_date AS filed FROM stmts UNION ALL SELECT ticker, CAST(date_trunc('quarter', period_end) AS DATE), period_end, revenue, filing_date FROM stmts WHERE fiscal_quarter = 3)""",
    "g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ticker, s, e ORDER BY filed, v) = 1)", "h AS (SELECT *, lag(e) OVER (PARTITION BY ticker, s ORDER BY e) AS le, lag(v) OVER (PARTITION BY ticker, s ORDER BY e) AS lv FROM g)",
    "i AS (SELECT ticker, s, e, filed, CASE WHEN date_diff('day', s, e) BETWEEN 70 AND 130 THEN v WHEN date_diff('day', le, e) BETWEEN 70 AND 130 THEN v - lv END AS value, CASE WHEN date_diff('day', s, e) BETWEEN 70 AND 130 THEN 'direct' ELSE 'difference' END AS how FROM h)",
    twin="SELECT ticker, e AS period_end, value, how FROM i WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, e ORDER BY CASE how WHEN 'direct' THEN 0 ELSE 1 END, filed, s) = 1")
def quarter_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir)
    total = rows.select("ticker", F.make_date("fiscal_year", F.lit(1), F.lit(1)).alias("period_start"), "period_end", F.sum("revenue").over(win.by("ticker", "fiscal_year", order="fiscal_quarter")).alias("value"), F.col("filing_date").alias("filed"))
    direct = rows.where("fiscal_quarter = 3").select("ticker", F.trunc("period_end", "quarter").alias("period_start"), "period_end", F.col("revenue").alias("value"), F.col("filing_date").alias("filed"))
    return facts.quarter_facts(total.unionByName(direct), ["ticker"])


@query(twin="""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'eco' WHEN lower(regexp_replace(p_name, '\\s+', '', 'g')) = 'redwidget' THEN 'red' WHEN contains(lower(regexp_replace(p_name, '\\s+', '', 'g')), 'bolt') THEN 'bolts' WHEN contains(lower(regexp_replace(p_name, '\\s+', '', 'g')), 'small') THEN 'small' END AS metric,
 CASE WHEN p_type = 'ECONOMY' THEN 0 WHEN lower(regexp_replace(p_name, '\\s+', '', 'g')) = 'redwidget' THEN 10 WHEN contains(lower(regexp_replace(p_name, '\\s+', '', 'g')), 'bolt') OR contains(lower(regexp_replace(p_name, '\\s+', '', 'g')), 'small') THEN 20 ELSE 999 END AS match_priority FROM part""")
def account_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("account_id"), F.col("p_name").alias("account_name"))
    ids = spark.createDataFrame([("ECONOMY", "eco")], "id string, metric string")
    names = spark.createDataFrame([("redwidget", "red")], "name string, metric string")
    patterns = spark.createDataFrame([(1, "bolt", "bolts"), (2, "small", "small")], "rank int, pattern string, metric string")
    return facts.canonical_accounts(rows, ids, names, patterns).select("p_partkey", "metric", "match_priority")


@query(STATEMENTS, BARS, """pr AS (SELECT s.ticker, s.period_end, b.close * s.shares / s.net_income AS per, s.net_income / s.shares AS eps FROM stmts s ASOF LEFT JOIN bars b ON b.ticker = s.ticker AND s.period_end >= b.date WHERE s.net_income > 0)""",
    "q AS (SELECT ticker, CASE WHEN count(per) FILTER (per > 0) >= 10 THEN quantile_cont(per, [0.1, 0.25, 0.5, 0.75, 0.9]) FILTER (per > 0) ELSE [8.0, 12.0, 16.0, 20.0, 25.0] END AS l FROM pr GROUP BY ticker)",
    twin="SELECT pr.ticker, period_end, round(eps * l[1], 3) AS low, round(eps * l[3], 3) AS mid, round(eps * l[5], 3) AS high FROM pr JOIN q ON q.ticker = pr.ticker")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir).where("net_income > 0").select("ticker", "period_end", "shares", "net_income")
    priced = asof.at_period_end(rows, ad.prices(spark, sf_dir), ["ticker"], "period_end", "date", ["close"], "price")
    multiples = priced.select("ticker", "period_end", (F.col("price") * F.col("shares") / F.col("net_income")).alias("per"), (F.col("net_income") / F.col("shares")).alias("eps"))
    out = facts.price_bands(multiples, "per", multiples.select("ticker", "period_end", "eps"))
    return out.select("ticker", "period_end", *(F.round(f"band_{k}", 3).alias(n) for k, n in ((1, "low"), (3, "mid"), (5, "high"))))


@query(BARS, """c AS (SELECT ticker, date, close, volume, open FROM bars WHERE date IN (SELECT max(date) FROM bars GROUP BY date_trunc('month', date)))""", "d AS (SELECT year(date) AS year, date, count(*) AS listed, count_if(volume >= 10) AS liquid, count_if(volume >= 10 AND close > 200000) AS rule FROM c GROUP BY 1, 2)",
    twin="SELECT year, round(avg(listed), 6) AS listed, round(avg(liquid), 6) AS liquid, round(avg(rule), 6) AS rule, CAST(count_if(rule = 0 AND liquid > 0) AS BIGINT) AS empty_at_rule FROM d GROUP BY year")
def rebalance_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = ad.prices(spark, sf_dir)
    cross = prices.join(screen.rebalance_dates(prices, "month"), "date", "left_semi").withColumn("year", F.year("date"))
    out = facts.funnel(cross, {"listed": F.lit(True), "liquid": F.col("volume") >= 10, "rule": F.col("close") > 200000}, ["year"])
    return out.select("year", *(F.round(c, 6).alias(c) for c in ("listed", "liquid", "rule")), "empty_at_rule")


@query(STATEMENTS, _FACTS, _OTHER, """e AS (SELECT a.ticker, a.metric, abs(a.value - b.value) / abs(a.value) AS err FROM facts a JOIN src2 b ON a.ticker = b.ticker AND a.period_end = b.period_end AND a.metric = b.metric WHERE a.value <> 0)""",
    twin="SELECT metric, round(avg(CAST(err <= 0.05 AS INTEGER)), 6) AS within_5, round(avg(CAST(err <= 0.2 AS INTEGER)), 6) AS within_20 FROM e GROUP BY metric")
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = ("revenue", "cogs", "net_income")
    other = ad.second_source(spark, sf_dir, *metrics).select("ticker", "period_end", "metric", F.col("value").alias("v2"))
    errors = ad.facts(spark, sf_dir, *metrics).where("value <> 0").join(other, ["ticker", "period_end", "metric"]).withColumn("error", F.abs(F.col("value") - F.col("v2")) / F.abs("value"))
    out = reconcile.hit_rates(errors, ["metric"], (0.05, 0.2))
    return out.select("metric", F.round("within_5", 6).alias("within_5"), F.round("within_20", 6).alias("within_20"))


@query(STATEMENTS, _FACTS, "l AS (SELECT ticker, period_end, metric, value FROM facts)", "p AS (SELECT a.ticker, a.metric AS name, b.metric AS match, count(*) AS n, greatest(avg(CAST(abs(a.value - b.value) <= 0.15 * abs(a.value) AS INTEGER)), 1 - least(1, coalesce(stddev_pop(b.value / nullif(a.value, 0)) / abs(nullif(avg(b.value / nullif(a.value, 0)), 0)), 1))) AS score FROM l a JOIN l b ON a.ticker = b.ticker AND a.period_end = b.period_end GROUP BY 1, 2, 3)",
    twin="SELECT ticker, name, match, n, round(score, 5) AS score FROM p WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY ticker, name ORDER BY score DESC, match) = 1")
def segment_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.facts(spark, sf_dir, "revenue", "cogs", "net_income").select("ticker", "period_end", F.col("metric").alias("name"), "value")
    return reconcile.best_match(rows, rows, "ticker", "period_end", "name", "value").withColumn("score", F.round("score", 5))


@query(twin="""SELECT o_custkey AS k, CASE WHEN min(p) IN (1, 2) THEN sum(v) ELSE arg_min(v, o_orderkey) END AS v FROM (SELECT o_custkey, o_orderkey, o_totalprice AS v, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, rank() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1), o_orderstatus) AS r FROM orders) WHERE r = 1 GROUP BY o_custkey""".replace("sum(v)", "CAST(sum(CAST(v AS DECIMAL(18, 2))) AS DOUBLE)"))
def priority_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v"), F.substring("o_orderpriority", 1, 1).alias("p"), "o_orderstatus")
    out = dedupe.by_priority(rows.withColumn("additive", F.col("p").isin("1", "2")), ["k"], ["p", "o_orderstatus"], "o_orderkey", "v", "additive")
    return out.withColumn("v", F.col("v").cast("double"))


@query("a AS (SELECT o_custkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, o_orderstatus AS s, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2, 3)", twin="SELECT k, d, max(CASE WHEN s = 'O' THEN v END) AS o, max(CASE WHEN s = 'F' THEN v END) AS f, max(CASE WHEN s = 'P' THEN v END) AS p FROM a GROUP BY 1, 2")
def measures_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.trunc("o_orderdate", "month").alias("d"), "o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    part = lambda s: rows.where(F.col("o_orderstatus") == s).select("k", "d", F.col("v").alias(s.lower()))
    return reconcile.outer_join([part("O"), part("F"), part("P")], ["k", "d"])


@query("s AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, product(CASE WHEN l_linenumber = 1 AND l_partkey % 400 = 0 THEN 2.0 WHEN l_linenumber = 2 AND l_partkey % 400 = 1 THEN 0.5 ELSE 1.0 END) AS ratio FROM lineitem GROUP BY 1, 2)", twin=f"SELECT ticker, date, coalesce(product(ratio) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS factor FROM s")
def future_split_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod("l_partkey", F.lit(400))
    ratio = F.when((F.col("l_linenumber") == 1) & (part == 0), 2.0).when((F.col("l_linenumber") == 2) & (part == 1), 0.5).otherwise(1.0)
    rows = ad.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(F.product(ratio).alias("ratio"))
    return rows.select("ticker", "date", st.split_factor(win.by("ticker"), "ratio").alias("factor"))


@query(STATEMENTS, twin="""SELECT 'statements' AS relation, count(*) AS n, min(period_end) AS first, max(period_end) AS last, 0.0::DOUBLE AS null_ticker, count(DISTINCT ticker) AS distinct_ticker FROM stmts
 UNION ALL SELECT 'orders', count(*), min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), 0.0, count(DISTINCT o_custkey) FROM orders""")
def table_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("period_end"))
    return quality.survey([quality.summary(ad.statements(spark, sf_dir), "statements", "period_end", ["ticker"]), quality.summary(orders, "orders", "period_end", ["ticker"])])


@query(BARS, twin="SELECT ticker, series FROM (SELECT ticker, series, median(s) AS r FROM (SELECT ticker, series, abs(ln(v) - lag(ln(v)) OVER (PARTITION BY ticker, series ORDER BY date)) AS s FROM bars UNPIVOT (v FOR series IN (high, low, close)) WHERE v > 0) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY round(r, 9), CASE series WHEN 'high' THEN 0 WHEN 'low' THEN 1 ELSE 2 END) = 1")
def smoothest_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.smoothest(ad.prices(spark, sf_dir), {"a": "high", "b": "low", "c": "close"}, order="date")


@query("t AS (SELECT l_suppkey AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(l_extendedprice AS DECIMAL(18, 2)) AS v FROM lineitem)", twin="SELECT ticker, period, CAST(sum(CASE WHEN side = 'buy' THEN v END) AS DOUBLE) AS buy, CAST(sum(CASE WHEN side = 'sell' THEN v END) AS DOUBLE) AS sell FROM t GROUP BY 1, 2")
def trade_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = ad.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_extendedprice").cast("decimal(18,2)").alias("notional"))
    out = perf.trade_pivot(trades)
    return out.select("ticker", "period", F.col("buy").cast("double").alias("buy"), F.col("sell").cast("double").alias("sell"))


@query(STATEMENTS, twin="""SELECT s.ticker, s.period_end, t.period_end AS found, t.revenue AS value FROM stmts s LEFT JOIN stmts t ON t.ticker = s.ticker AND abs(date_diff('day', s.filing_date, t.period_end)) <= 60 QUALIFY row_number() OVER (PARTITION BY s.ticker, s.period_end ORDER BY abs(date_diff('day', s.filing_date, t.period_end)), t.period_end) = 1""")
def nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir).select("ticker", "period_end", "filing_date")
    lookup = ad.statements(spark, sf_dir).select("ticker", F.col("period_end").alias("d"), F.struct(F.col("period_end").alias("found"), F.col("revenue").alias("value")).alias("v"))
    out = reconcile.nearest_value(rows, lookup, ["ticker"], ["filing_date"], "d", "v", 60)
    return out.select("ticker", "period_end", F.col("v.found").alias("found"), F.col("v.value").alias("value"))


@query("o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN -o_totalprice ELSE o_totalprice END AS x, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS c FROM orders)", twin="SELECT k, round(CASE WHEN x IS NULL THEN c WHEN x < 0 AND c >= 0 THEN c ELSE x END, 3) AS x FROM o")
def keep_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    rows = ad.table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 4 == 0, None).when(k % 7 == 0, -v).otherwise(v).alias("x"))
    other = ad.table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 3 == 0, v + 1).otherwise(v).alias("x"))
    return dedupe.keep_better(rows, other, ["k"], ["x"]).withColumn("x", F.round("x", 3))


