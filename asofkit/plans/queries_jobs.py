"""Queries over whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as col
from ..operators import dedupe, quality, reconcile, screen
from ..sources import adapters as ad
from . import jobs
from .queries_records import _INTERVALS, _intervals
from .registry import BARS, EVENTS, FILINGS, STATEMENTS, query

_LASTN = "PARTITION BY ticker ORDER BY period_end"


@query(STATEMENTS, BARS, f"e AS (SELECT ticker, period_end, CASE WHEN count(net_income) OVER x = 4 THEN sum(net_income) OVER x END / shares AS eps FROM stmts WINDOW x AS ({_LASTN} ROWS 3 PRECEDING))",
    "p AS (SELECT e.*, CASE WHEN eps > 0 THEN b.close / eps END AS per, row_number() OVER (PARTITION BY e.ticker ORDER BY period_end DESC) AS n FROM e ASOF LEFT JOIN bars b ON b.ticker = e.ticker AND e.period_end >= b.date WHERE eps IS NOT NULL)",
    "w AS (SELECT *, '5y' AS \"window\" FROM p WHERE n <= 20 UNION ALL SELECT *, '10y' FROM p WHERE n <= 40 UNION ALL SELECT *, 'all' FROM p)",
    "q AS (SELECT ticker, \"window\", CASE WHEN count(per) >= 10 THEN quantile_cont(per, [0.1, 0.5, 0.9]) ELSE [8.0, 16.0, 25.0] END AS l FROM w GROUP BY 1, 2)",
    twin="SELECT w.\"window\", w.ticker, period_end, round(eps * l[1], 3) AS low, round(eps * greatest(l[1], l[2]), 3) AS mid FROM w JOIN q ON q.ticker = w.ticker AND q.\"window\" = w.\"window\"")
def valuation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.valuation_payload(ad.statements(spark, sf_dir), ad.prices(spark, sf_dir))
    return out.select("window", "ticker", "period_end", F.round("band_1", 3).alias("low"), F.round("band_3", 3).alias("mid"))


@query(STATEMENTS, f"t AS (SELECT ticker, period_end, equity, sum(revenue) OVER x / count(revenue) OVER x * 4 AS revenue, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS n FROM stmts WINDOW x AS ({_LASTN} ROWS 3 PRECEDING))",
    "l AS (SELECT ticker, period_end, n, 'revenue' AS metric, revenue AS value FROM t UNION ALL SELECT ticker, period_end, n, 'equity', equity FROM t UNION ALL SELECT ticker, period_end, n, 'turnover', revenue / equity FROM t)",
    twin="SELECT ticker, period_end, metric, round(value, 4) AS value, round(yoy, 4) AS yoy FROM (SELECT *, (value / lag(value, 4) OVER (PARTITION BY ticker, metric ORDER BY period_end) - 1) * 100 AS yoy FROM l) WHERE n <= 12")
def statement_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.statement_view(ad.statements(spark, sf_dir), ["revenue", "equity"], {"turnover": col.safe_div("revenue", "equity")}, "ttm", 3, ["revenue"])
    return out.select("ticker", "period_end", "metric", F.round("value", 4).alias("value"), F.round("yoy", 4).alias("yoy"))


@query(BARS, EVENTS, _INTERVALS, twin="SELECT b.ticker, b.date, b.close, i.valid_from AS proof FROM bars b JOIN iv i ON i.ticker = b.ticker AND b.date >= i.valid_from AND b.date <= coalesce(i.valid_to, DATE '9999-12-31') QUALIFY row_number() OVER (PARTITION BY b.ticker, b.date ORDER BY i.valid_from DESC) = 1")
def members_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = _intervals(spark, sf_dir).withColumn("proof", F.col("valid_from"))
    return screen.members_only(ad.prices(spark, sf_dir).select("ticker", "date", "close"), proof, ["proof"])


@query(BARS, "v AS (SELECT ticker, CASE WHEN ticker % 3 = 0 THEN DATE '1997-01-01' ELSE min(date) END AS a, CASE WHEN ticker % 3 = 0 THEN DATE '1999-12-31' ELSE max(date) END AS z FROM bars GROUP BY ticker)", twin="SELECT b.ticker, b.date, b.close FROM bars b JOIN v ON v.ticker = b.ticker AND b.date BETWEEN a AND z")
def validity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = ad.prices(spark, sf_dir).select("ticker", "date", "close")
    bounds = prices.where("ticker % 3 = 0").select("ticker").distinct().select("ticker", F.lit("1997-01-01").cast("date").alias("first_valid"), F.lit("1999-12-31").cast("date").alias("last_valid"))
    return screen.within_validity(prices, bounds)


@query(FILINGS, twin="SELECT 'opex' AS candidate, count(*) AS n, count(opex) AS present, count(DISTINCT CASE WHEN opex IS NOT NULL THEN ticker END) AS keys, min(CASE WHEN opex IS NOT NULL THEN period_end END) AS first, max(CASE WHEN opex IS NOT NULL THEN period_end END) AS last, 2 * count(opex) >= count(*) AS ready FROM filings UNION ALL SELECT 'revenue', count(*), count(revenue), count(DISTINCT ticker), min(period_end), max(period_end), TRUE FROM filings")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.readiness(ad.filings(spark, sf_dir), ["opex", "revenue"], "ticker", "period_end")


@query(STATEMENTS, twin="SELECT ticker, period_end, coalesce(a.revenue, b.revenue) AS revenue, coalesce(a.opex, b.opex) AS opex FROM (SELECT ticker, period_end, revenue, opex FROM stmts WHERE ticker % 4 <> 1) a FULL JOIN (SELECT ticker, period_end, revenue + 1 AS revenue, cogs AS opex FROM stmts WHERE ticker % 4 <> 2) b USING (ticker, period_end)")
def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir)
    a = rows.where("ticker % 4 <> 1").select("ticker", "period_end", "revenue", "opex")
    b = rows.where("ticker % 4 <> 2").select("ticker", "period_end", (F.col("revenue") + 1).alias("revenue"), F.col("cogs").alias("opex"))
    return dedupe.merged_blocks(a, b, ["ticker", "period_end"])


@query("l AS (SELECT p_partkey, p_size, p_name AS a, replace(lower(p_name), ' ', '') AS k FROM part)", "r AS (SELECT DISTINCT p_size, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS n, replace(lower(p_name), ' ', '') AS q FROM part)",
    twin="""SELECT l.p_partkey, r.n AS match FROM l LEFT JOIN r ON r.p_size = l.p_size AND (l.a = r.n OR l.k = r.q OR (length(l.k) >= 3 AND length(r.q) >= 3 AND (contains(l.k, r.q) OR contains(r.q, l.k))))
 QUALIFY row_number() OVER (PARTITION BY l.p_partkey ORDER BY CASE WHEN l.a = r.n THEN 0 WHEN l.k = r.q THEN 1 ELSE 2 END, r.n) = 1""")
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = ad.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("period"), F.col("p_name").alias("name"))
    right = part.select("period", F.when(F.col("p_partkey") % 2 == 0, F.col("name")).otherwise(F.upper("name")).alias("name"), F.lit(1.0).alias("v")).distinct()
    return reconcile.name_match(part, right, "period", "name", "v", ["p_partkey"]).select("p_partkey", "match")
