"""Queries over tables: reads, sinks, unions, pruning, filings, memberships, audits and whole jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as col
from ..functions import windows as win
from ..operators import coverage, dedupe, facts, intervals, perf, products, quality, reconcile, screen
from ..operators import statements as st
from ..sources import adapters as ad
from ..sources import io, shared, store
from ..streaming import streams
from . import jobs
from . import panel as pl
from .queries_market import PANEL_TWIN
from .queries_records import _INTERVALS, _intervals
from .registry import BARS, EVENTS, FILINGS, STATEMENTS, query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_totalprice").alias("value"))


_ORDERS = "od AS (SELECT o_orderkey AS k, o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS status, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_totalprice AS value FROM orders)"

# reads


@query(STATEMENTS, twin="SELECT ticker, period_end, CAST(fiscal_year AS VARCHAR) AS fiscal_year, revenue + CASE WHEN fiscal_year >= 1998 THEN 1 ELSE 0 END AS revenue FROM stmts")
def partition_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = shared.folder(spark, "partitions"), ad.statements(spark, sf_dir).select("ticker", "period_end", "fiscal_year", "revenue")
    io.replace(rows, folder, ["fiscal_year"])
    io.replace_partitions(rows.where("fiscal_year >= 1998").withColumn("revenue", F.col("revenue") + 1), folder, ["fiscal_year"])
    return io.read_partitioned(spark, folder).select("ticker", "period_end", "fiscal_year", "revenue")


@query(STATEMENTS, twin="SELECT ticker, period_end, CAST(NULL AS DATE) AS filing_date, revenue FROM stmts WHERE form = '10-K' AND ticker BETWEEN 0 AND 599")
def bulk_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir).select("ticker", F.col("period_end").cast("string").alias("period_end"), F.concat(F.lit("x"), F.col("filing_date").cast("string")).alias("filing_date"), F.col("form").alias("market"), "revenue")
    return io.bulk_financials(rows, range(600), market="10-K", columns=["ticker", "period_end", "filing_date", "revenue"])


@query(STATEMENTS, twin="SELECT ticker, period_end, form, revenue FROM stmts WHERE form = '10-Q' AND period_end BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.filtered_scan(ad.statements(spark, sf_dir), ["ticker", "period_end", "form", "unknown", "revenue"], "period_end", "1996-01-01", "1998-12-31", form="10-Q")


@query(BARS, EVENTS, "l AS (SELECT ticker, max(date) AS d, arg_max(action, event_id) AS a FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS m FROM events_m WHERE date >= DATE '1996-01-01') WHERE date = m GROUP BY ticker)",
    "lx AS (SELECT ticker, date AS d, action AS a, event_id AS e, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, action DESC, event_id DESC) AS n FROM events_m WHERE date >= DATE '1996-01-01')",
    twin="SELECT b.ticker, b.date, CAST(b.volume AS BIGINT) AS volume, x.d AS event_date, x.a AS action, x.e AS event_id FROM bars b LEFT JOIN lx x ON x.ticker = b.ticker AND x.n = 1 WHERE b.date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND close > 100000")
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ad.membership_events(spark, sf_dir).withColumnRenamed("date", "event_date")
    out = io.chunk_scan(ad.prices(spark, sf_dir).select("ticker", "date", "close", "volume"), "date", "1996-01-01", "1997-12-31", "close > 100000", {"volume": "bigint"}, events, "ticker", ["action", "event_id"])
    return out.drop("close")


@query(STATEMENTS, twin="SELECT lpad(CAST(ticker AS VARCHAR), 6, '0') AS ticker, count(*) AS n, sum(revenue) AS revenue, count(opex) AS n_opex, CAST(0 AS BIGINT) AS n_dividends FROM stmts GROUP BY ticker")
def typed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = shared.folder(spark, "reports"), ad.statements(spark, sf_dir)
    io.report_files({"quarters": rows.select("ticker", "period_end", "revenue", "opex", F.lit("x").alias("dividends"))}, folder, "csv")
    read = io.read_files(spark, f"{folder}/quarters", "csv", {"ticker": "bigint", "period_end": "date", "revenue": "double", "opex": "double", "dividends": "double", "splits": "double"}, ["ticker"])
    io.views(spark, {"asofkit_quarters": read}, pad="ticker")
    return spark.sql("SELECT ticker, count(period_end) AS n, sum(revenue) AS revenue, count(opex) AS n_opex, count(dividends) AS n_dividends FROM asofkit_quarters GROUP BY ticker")


@query(twin="SELECT DISTINCT upper(trim(p_brand)) AS ticker FROM part")
def ticker_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.folder(spark, "symbols")
    lines = ad.table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(","), F.col("p_name")).alias("value"))
    lines.unionByName(spark.range(1).select(F.lit("symbol,name").alias("value"))).write.text(folder)
    return io.tickers(spark, folder).select("ticker")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts documents by ticker: revenue as running totals of the year, assets as instants."""
    rows = ad.statements(spark, sf_dir).withColumns({"ytd": F.sum("revenue").over(win.by("ticker", "fiscal_year", order="fiscal_quarter")), "start": F.make_date("fiscal_year", F.lit(1), F.lit(1))})
    record = lambda start, value: F.struct(start.cast("string").alias("start"), F.col("period_end").cast("string").alias("end"), value.alias("val"), F.concat_ws("-", "ticker", "period_end").alias("accn"), F.col("form"), F.col("filing_date").cast("string").alias("filed"))
    unit = lambda rows_: F.struct(F.create_map(F.lit("USD"), rows_).alias("units"))
    own = rows.groupBy("ticker").agg(F.sort_array(F.collect_list(record(F.col("start"), F.col("ytd")))).alias("r"), F.sort_array(F.collect_list(record(F.lit(None), F.col("assets")))).alias("a"))
    return own.select("ticker", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), unit(F.col("r")), F.lit("Assets"), unit(F.col("a")))).alias("facts"))).alias("json"))


@query(STATEMENTS, twin="SELECT ticker, 'Revenues' AS concept, make_date(fiscal_year, 1, 1) AS period_start, period_end, sum(revenue) OVER (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter) AS value, form, filing_date AS filed FROM stmts UNION ALL SELECT ticker, 'Assets', NULL, period_end, assets, form, filing_date FROM stmts")
def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.company_facts(_documents(spark, sf_dir)).select("ticker", "concept", "period_start", "period_end", "value", "form", "filed")


@query(STATEMENTS, "y AS (SELECT *, sum(revenue) OVER w AS t, lag(period_end) OVER w AS before, count(*) OVER (PARTITION BY ticker, fiscal_year) AS n, max(CASE WHEN date_diff('day', make_date(fiscal_year, 1, 1), period_end) BETWEEN 131 AND 320 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, fiscal_year) AS half, row_number() OVER w AS i FROM stmts WINDOW w AS (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter))",
    twin="SELECT ticker, period_end, CASE WHEN fiscal_quarter = 1 THEN revenue WHEN n >= 3 AND half = 1 AND i > 1 THEN revenue END AS revenue, assets, filing_date AS available_date, 'filed' AS method FROM y")
def facts_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = io.company_facts(_documents(spark, sf_dir))
    return jobs.facts_to_quarters(raw, {"Revenues": "revenue"}, {"Assets": "assets"}).select("ticker", "period_end", "revenue", "assets", "available_date", "method")


_CHAINED = """f AS (SELECT ticker, make_date(fiscal_year, 1, 1) AS s, period_end AS e, sum(revenue) OVER (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter) AS v, filing_date AS filed FROM stmts
 UNION ALL SELECT ticker, make_date(fiscal_year, 1, 1), period_end, revenue, filing_date + 30 FROM stmts WHERE fiscal_quarter >= 3 UNION ALL SELECT ticker, make_date(fiscal_year, 7, 1), period_end, revenue + 5, filing_date FROM stmts WHERE fiscal_quarter = 3)"""


@query("RECURSIVE " + STATEMENTS, _CHAINED, "b AS (SELECT *, date_diff('day', s, e) AS days, row_number() OVER (PARTITION BY ticker, s, e ORDER BY filed DESC, v DESC) AS r FROM f WHERE v IS NOT NULL)",
    "d AS (SELECT ticker, e, v FROM b WHERE days BETWEEN 70 AND 130 QUALIFY row_number() OVER (PARTITION BY ticker, e ORDER BY filed DESC, v DESC) = 1)", "g AS (SELECT ticker, s, e, min(days) AS days, list(v ORDER BY r) AS c FROM b GROUP BY 1, 2, 3)",
    "h AS (SELECT *, row_number() OVER (PARTITION BY ticker, s ORDER BY e) AS n, count(*) OVER (PARTITION BY ticker, s) AS m, max(CASE WHEN days BETWEEN 131 AND 320 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, s) AS half FROM g)",
    "r AS (SELECT ticker, s, e, n, c[1] AS total, CASE WHEN days BETWEEN 70 AND 130 THEN c[1] END AS q FROM h WHERE n = 1 AND m >= 3 AND half = 1 UNION ALL SELECT ticker, s, e, n, p, p - total FROM (SELECT h.*, r.total, CASE WHEN h.c[1] < 0.85 * r.total THEN coalesce(list_filter(h.c, lambda x: x >= 0.85 * r.total)[1], h.c[1]) ELSE h.c[1] END AS p FROM r JOIN h ON h.ticker = r.ticker AND h.s = r.s AND h.n = r.n + 1))",
    "k AS (SELECT ticker, e, arg_max(q, s) AS q FROM r WHERE q IS NOT NULL GROUP BY 1, 2)",
    twin="SELECT coalesce(d.ticker, k.ticker) AS ticker, coalesce(d.e, k.e) AS period_end, coalesce(d.v, k.q) AS value, CASE WHEN d.ticker IS NULL THEN 'difference' ELSE 'direct' END AS how FROM d FULL JOIN k ON k.ticker = d.ticker AND k.e = d.e")
def quarters_from_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, w = ad.statements(spark, sf_dir), win.by("ticker", "fiscal_year", order="fiscal_quarter")
    at = lambda month: F.make_date("fiscal_year", F.lit(month), F.lit(1)).alias("period_start")
    total = rows.select("ticker", at(1), "period_end", F.sum("revenue").over(w).alias("value"), F.col("filing_date").alias("filed"))
    fallen = rows.where("fiscal_quarter >= 3").select("ticker", at(1), "period_end", F.col("revenue").alias("value"), F.date_add("filing_date", 30).alias("filed"))
    direct = rows.where("fiscal_quarter = 3").select("ticker", at(7), "period_end", (F.col("revenue") + 5).alias("value"), F.col("filing_date").alias("filed"))
    return facts.quarters_from_facts(total.unionByName(fallen).unionByName(direct), ["ticker"])


@query(STATEMENTS, twin="SELECT make_date(fiscal_year, 12, 31) AS date, sum(cogs) AS cogs, sum(revenue) AS revenue FROM stmts WHERE fiscal_year BETWEEN 1996 AND 1998 GROUP BY fiscal_year")
def transposed_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = {f"{y}-12-31": F.col("fiscal_year") == y for y in (1996, 1997, 1998)}
    by_metric = st.conditional_sums(ad.facts(spark, sf_dir, "revenue", "cogs"), ["metric"], years)
    return io.transposed(by_metric, "metric", list(years))


@query(BARS, STATEMENTS, "p AS (SELECT ticker, count(*) AS n, arg_max(close, date) FILTER (close > 150000) AS cap FROM bars GROUP BY ticker)", "q AS (SELECT ticker, count(*) AS n FROM stmts WHERE form = '10-K' GROUP BY ticker)",
    twin="SELECT s_suppkey AS ticker, p.n IS NOT NULL AS has_prices, q.n IS NOT NULL AS has_financials, p.cap AS market_cap, CAST(coalesce(q.n, 0) AS INTEGER) AS n_periods, s_acctbal AS balance, CAST(NULL AS DOUBLE) AS dividends FROM supplier LEFT JOIN p ON p.ticker = s_suppkey LEFT JOIN q ON q.ticker = s_suppkey")
def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = ad.prices(spark, sf_dir).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", F.when(F.col("close") > 150000, F.col("close")).otherwise(-1.0).alias("market_cap")))).alias("p"))
    reports = ad.statements(spark, sf_dir).where("form = '10-K'").groupBy("ticker").agg(F.sort_array(F.collect_list("period_end")).alias("f"))
    master = io.with_optional(ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_acctbal").alias("balance")), ["ticker"], {"balance": "double", "dividends": "double"})
    docs = master.join(prices, "ticker", "left").join(reports, "ticker", "left").select("ticker", F.struct(F.col("p.date").alias("date"), F.col("p.market_cap").alias("market_cap")).alias("prices"), F.struct(F.col("f").alias("periods")).alias("financials"))
    return io.document_flags(docs).join(master, "ticker")


# sinks and upserts


@query(_ORDERS, "b AS (SELECT DISTINCT ticker FROM od WHERE status = 'P')",
    twin="SELECT 'totals' AS relation, ticker, k, value FROM od WHERE ticker NOT IN (SELECT ticker FROM b) UNION ALL SELECT 'totals', ticker, k, value * 2 FROM od WHERE status = 'P' UNION ALL SELECT 'ranks', ticker, k, CAST(priority AS DOUBLE) FROM od WHERE ticker NOT IN (SELECT ticker FROM b)")
def batch_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    totals, ranks = rows.select("ticker", "k", "value"), rows.select("ticker", "k", F.col("priority").cast("double").alias("value"))
    fresh = rows.where("status = 'P'").select("ticker", "k", (F.col("value") * 2).alias("value"))
    kept = store.Store(spark, shared.folder(spark, "replaced"), {"totals": ["ticker"], "ranks": ["ticker"]}, 8)
    kept.replace(("load", 0), {"totals": totals, "ranks": ranks})
    for _ in range(2):  # the second time finds the batch in the manifest
        kept.replace(("batch", 0), {"totals": fresh}, {"ranks": fresh})
    return quality.survey([kept.read(name).withColumn("relation", F.lit(name)) for name in kept.tables])


@query(BARS, twin="SELECT ticker, date, CASE WHEN date = max(date) OVER (PARTITION BY ticker) THEN close * 1000 END AS market_cap FROM bars")
def latest_row_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.prices(spark, sf_dir).withColumn("market_cap", F.lit(None).cast("double"))
    return dedupe.set_latest(rows, "ticker", "date", "market_cap", F.col("close") * 1000).select("ticker", "date", "market_cap")


@query(twin="SELECT s_suppkey AS ticker, s_name AS name, n_name AS nation, 'master' AS source_relation, 'run-1' AS run_id, TRUE AS stamped FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def master_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.folder(spark, "master")
    io.export_json(io.audited(ad.master(spark, sf_dir).select("ticker", "name", "nation"), "master", "run-1"), folder, ["nation"])
    back = spark.read.schema("ticker long, name string, source_relation string, run_id string, collected_at timestamp, nation string").json(folder)
    return back.select("ticker", "name", "nation", "source_relation", "run_id", F.col("collected_at").isNotNull().alias("stamped"))


@query(_ORDERS, twin="SELECT ticker, date, k, value FROM od QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY priority DESC, k DESC, value DESC) = 1")
def newest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.newest_batch(_orders(spark, sf_dir).select("ticker", "date", "k", "value", "priority"), ["ticker", "date"], "priority").drop("priority")


# one row per key, unions, joins


@query(STATEMENTS, "a AS (SELECT ticker, period_end + CAST(ticker % 21 - 10 AS INTEGER) AS d, opex, revenue, filing_date FROM stmts UNION ALL SELECT ticker, period_end + CAST(ticker % 31 - 5 AS INTEGER), opex, NULL, filing_date + 5 FROM stmts)",
    "b AS (SELECT *, CAST(date_trunc('quarter', d) - INTERVAL 1 DAY AS DATE) AS qb, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS qe FROM a)", "c AS (SELECT ticker, CASE WHEN date_diff('day', qb, d) <= 15 THEN qb WHEN date_diff('day', d, qe) <= 15 THEN qe ELSE d END AS period_end, opex, revenue, filing_date FROM b)",
    twin="SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ticker, period_end ORDER BY CAST(opex IS NOT NULL AS INTEGER) + CAST(revenue IS NOT NULL AS INTEGER) DESC, filing_date DESC) = 1")
def snapped_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir)
    moved = lambda n, k: F.date_add("period_end", (F.col("ticker") % n - k).cast("int")).alias("period_end")
    a = rows.select("ticker", moved(21, 10), "opex", "revenue", "filing_date")
    b = rows.select("ticker", moved(31, 5), "opex", F.lit(None).cast("double").alias("revenue"), F.date_add("filing_date", 5).alias("filing_date"))
    return dedupe.per_snapped_quarter(a.unionByName(b), "ticker", ["opex", "revenue"], ["filing_date"])


@query(STATEMENTS, "l AS (SELECT * FROM stmts QUALIFY row_number() OVER (PARTITION BY ticker, year(period_end) ORDER BY period_end DESC) = 1)", "r AS (SELECT ticker, fiscal_year, sum(revenue) AS revenue, arg_max(assets, fiscal_quarter) AS assets, count(DISTINCT fiscal_quarter) AS n_quarters FROM stmts GROUP BY 1, 2)",
    twin="SELECT l.ticker, l.fiscal_year, l.period_end, l.revenue AS last_revenue, r.revenue, r.assets, r.n_quarters FROM l JOIN r ON r.ticker = l.ticker AND r.fiscal_year = l.fiscal_year")
def annual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir)
    last = st.annual_latest(rows.select("ticker", "fiscal_year", "period_end", F.col("revenue").alias("last_revenue"))).drop("year")
    return last.join(st.annual_by_rules(rows, {"revenue": "sum", "assets": "last"}), ["ticker", "fiscal_year"]).select("ticker", "fiscal_year", "period_end", "last_revenue", "revenue", "assets", "n_quarters")


@query(BARS, STATEMENTS, "h AS (SELECT ticker, arg_max(shares, period_end) AS s FROM stmts WHERE shares > 0 GROUP BY ticker)", "c AS (SELECT b.ticker, b.close * h.s AS cap FROM bars b JOIN h ON h.ticker = b.ticker WHERE b.date = (SELECT max(date) FROM bars) AND b.close * h.s > 0 AND b.close * h.s <= 1e13)",
    "t AS (SELECT ticker FROM c QUALIFY row_number() OVER (ORDER BY cap DESC, ticker) <= 20)", twin="SELECT 'statements' AS relation, ticker, count(*) AS n FROM stmts WHERE ticker IN (SELECT ticker FROM t) GROUP BY ticker UNION ALL SELECT 'prices', ticker, count(*) FROM bars WHERE ticker IN (SELECT ticker FROM t) GROUP BY ticker")
def top_with_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, rows = ad.prices(spark, sf_dir), ad.statements(spark, sf_dir)
    kept = dedupe.top_with_cascade(dedupe.top_by_market_cap(prices, rows, 20), {"statements": rows, "prices": prices}, 20)
    return quality.survey([df.groupBy("ticker").agg(F.count("*").alias("n")).withColumn("relation", F.lit(name)) for name, df in kept.items()])


@query(STATEMENTS, BARS, "t AS (SELECT s_suppkey AS ticker FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))",
    twin="SELECT 'statements' AS relation, ticker, count(*) AS n FROM stmts WHERE ticker IN (SELECT ticker FROM t) AND (fiscal_year, fiscal_quarter) IN ((1996, 1), (1996, 4), (1997, 2)) GROUP BY ticker UNION ALL SELECT 'prices', ticker, count(*) FROM bars WHERE ticker IN (SELECT ticker FROM t) GROUP BY ticker")
def pruned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ad.master(spark, sf_dir).where(F.col("region").isin("ASIA", "EUROPE"))
    rows = screen.target_periods(ad.statements(spark, sf_dir), [(1996, 1), (1996, 4), (1997, 2)])
    kept = dedupe.pruned({"statements": rows, "prices": ad.prices(spark, sf_dir)}, keep)
    return quality.survey([df.groupBy("ticker").agg(F.count("*").alias("n")).withColumn("relation", F.lit(name)) for name, df in kept.items()])


_FORMS = "g AS (SELECT ticker, period_end, CASE version WHEN 1 THEN form WHEN 2 THEN form || '/A' WHEN 3 THEN 'NT ' || form ELSE form END AS form, filing_date AS filed, CASE WHEN version < 4 THEN filing_date + version END AS accepted, ticker || '-' || period_end || '-' || version AS accession FROM filings)"


@query(FILINGS, _FORMS, "m AS (SELECT *, row_number() OVER (PARTITION BY ticker, period_end ORDER BY CASE WHEN starts_with(form, 'NT') THEN 1 ELSE 0 END, filed DESC, accepted DESC NULLS LAST, accession DESC, form DESC) AS n FROM (SELECT DISTINCT * FROM g))",
    twin="""SELECT ticker, period_end, max(CASE WHEN n = 1 AND NOT starts_with(form, 'NT') THEN form END) AS form, max(CASE WHEN n = 1 AND NOT starts_with(form, 'NT') THEN filed END) AS filed, max(CASE WHEN n = 1 AND NOT starts_with(form, 'NT') THEN accession END) AS accession, count(*) AS n_events, bool_or(ends_with(form, '/A')) AS is_amendment, bool_or(starts_with(form, 'NT')) AS is_nt FROM m GROUP BY ticker, period_end""")
def filing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("version")
    rows = ad.filings(spark, sf_dir).select("ticker", "period_end", F.when(v == 2, F.concat("form", F.lit("/A"))).when(v == 3, F.concat(F.lit("NT "), "form")).otherwise(F.col("form")).alias("form"), F.col("filing_date").alias("filed"), F.when(v < 4, F.date_add("filing_date", v)).alias("accepted"), F.concat_ws("-", "ticker", "period_end", "version").alias("accession"))
    _, latest = facts.filing_events(rows.unionByName(rows), ["ticker"])
    return latest.drop("accepted")


@query(FILINGS, "l AS (SELECT ticker, period_end, CASE WHEN fiscal_quarter <> 2 THEN filing_date END AS filing_date, revenue FROM filings WHERE version = 1)", "r AS (SELECT ticker, period_end, CASE WHEN fiscal_quarter <> 2 THEN filing_date END AS filing_date, net_income AS extra, version FROM filings)",
    twin="SELECT l.*, r.extra FROM l LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ticker, period_end, filing_date ORDER BY version DESC) = 1) r ON r.ticker = l.ticker AND r.period_end = l.period_end AND r.filing_date IS NOT DISTINCT FROM l.filing_date")
def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.filings(spark, sf_dir).withColumn("filing_date", F.when(F.col("fiscal_quarter") != 2, F.col("filing_date")))
    right = rows.select("ticker", "period_end", "filing_date", F.col("net_income").alias("extra"), "version")
    return dedupe.left_null_safe(rows.where("version = 1").select("ticker", "period_end", "filing_date", "revenue"), right, ["ticker", "period_end"], ["filing_date"], ["extra"], [F.col("version").desc()])


@query(STATEMENTS, BARS, "a AS (SELECT ticker, max(revenue) AS revenue, max(assets) AS assets FROM stmts GROUP BY ticker)", "b AS (SELECT ticker, max(close) AS close FROM bars GROUP BY ticker)",
    twin="SELECT coalesce(a.ticker, b.ticker) AS ticker, revenue, assets, close, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS nation, CASE WHEN n_name IS NOT NULL THEN 'other' ELSE 'master' END AS source FROM a FULL JOIN b ON b.ticker = a.ticker JOIN supplier ON s_suppkey = coalesce(a.ticker, b.ticker) LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = s_nationkey")
def united_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    united = dedupe.united_maxima([ad.statements(spark, sf_dir).select("ticker", "revenue"), ad.prices(spark, sf_dir).select("ticker", "close"), ad.statements(spark, sf_dir).select("ticker", "assets")], "ticker")
    master = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("key"), F.col("s_nationkey").cast("string").alias("nation"))
    names = ad.table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation"))
    return dedupe.overlay(united, reconcile.enriched(master, names, ["key"], ["nation"]).drop("key"), ["ticker"])


@query(_ORDERS, "fx AS (SELECT ticker, k AS accession, CAST(priority AS VARCHAR) AS code, CAST(date_trunc('month', date) AS DATE) AS pe, CASE WHEN status = 'O' THEN 'annual report ' ELSE 'notice ' END || strftime(date, '%Y.%m') AS name, date FROM od)",
    "s AS (SELECT r.k, f.accession, f.date, 16 * CAST(f.accession = r.k + 7 AS INTEGER) + 8 * CAST(f.code = CAST(6 - r.priority AS VARCHAR) AS INTEGER) + 4 * CAST(f.pe = CAST(date_trunc('month', r.date) AS DATE) AS INTEGER) + 2 * CAST(contains(f.name, 'report') AS INTEGER) + CAST(contains(f.name, strftime(CAST(date_trunc('month', r.date) AS DATE), '%Y.%m')) AS INTEGER) AS score FROM od r JOIN fx f ON f.ticker = r.ticker)",
    twin="SELECT k, accession AS filing, date AS filing_date FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, date DESC, accession DESC) = 1")
def best_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, month = _orders(spark, sf_dir), F.trunc("date", "month").alias("period_end")
    filings = rows.select("ticker", F.col("k").alias("accession"), F.col("priority").cast("string").alias("report_code"), month, F.concat(F.when(F.col("status") == "O", "annual report ").otherwise("notice "), F.date_format("date", "yyyy.MM")).alias("name"), F.col("date").alias("filing_date"))
    asked = rows.select("k", "ticker", (F.col("k") + 7).alias("accession"), (6 - F.col("priority")).cast("string").alias("report_code"), month)
    return facts.best_filing(asked, filings, "ticker", "k").select("k", "filing", "filing_date")


@query("c AS (SELECT c_custkey AS company, 'C' || lpad(CAST(c_nationkey * 7 + c_custkey % 400 AS VARCHAR), 7, '0') || 'AB' AS cusip, ' t' || CAST(c_custkey % 900 AS VARCHAR) AS tk, 1990 + c_nationkey AS a, 1995 + c_nationkey AS z FROM customer)", "s AS (SELECT s_suppkey AS security, 'C' || lpad(CAST(s_nationkey * 7 + s_suppkey AS VARCHAR), 7, '0') || 'XY' AS cusip, 'T' || CAST(s_suppkey AS VARCHAR) AS tk, 1992 + s_nationkey AS a, 1999 + s_nationkey AS z FROM supplier)",
    twin="SELECT DISTINCT company, security, greatest(c.a, s.a) AS valid_from, least(c.z, s.z) AS valid_to FROM c JOIN s ON (substr(c.cusip, 1, 8) = substr(s.cusip, 1, 8) OR upper(trim(c.tk)) = upper(trim(s.tk))) AND c.a <= s.z AND c.z >= s.a")
def identifier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda n, end: F.concat(F.lit("C"), F.lpad(n.cast("string"), 7, "0"), F.lit(end))
    c, s = ad.table(spark, sf_dir, "customer"), ad.table(spark, sf_dir, "supplier")
    companies = c.select(F.col("c_custkey").alias("company"), code(F.col("c_nationkey") * 7 + F.col("c_custkey") % 400, "AB").alias("cusip"), F.concat(F.lit(" t"), (F.col("c_custkey") % 900).cast("string")).alias("ticker"), (1990 + F.col("c_nationkey")).alias("first_year"), (1995 + F.col("c_nationkey")).alias("last_year"))
    securities = s.select(F.col("s_suppkey").alias("security"), code(F.col("s_nationkey") * 7 + F.col("s_suppkey"), "XY").alias("cusip"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), (1992 + F.col("s_nationkey")).alias("first_year"), (1999 + F.col("s_nationkey")).alias("last_year"))
    return facts.identifier_links(companies, securities)


@query("m AS (SELECT p_brand AS brand, p_size AS size, p_retailprice AS v, p_retailprice * CASE p_size % 4 WHEN 0 THEN 1.02 WHEN 1 THEN 1.08 WHEN 2 THEN 1.3 ELSE NULL END AS w, CASE p_type WHEN 'ECONOMY' THEN 1e3 WHEN 'PROMO' THEN 1e6 ELSE 1.0 END AS u FROM part)",
    twin="SELECT brand, count(w) AS matched, count_if(abs(v * u - w * u) / abs(v * u) <= 0.05) AS within_5, count_if(abs(v * u - w * u) / abs(v * u) <= 0.1) AS within_10, count_if(abs(v * u - w * u) / abs(v * u) <= 0.15) AS within_15 FROM m GROUP BY brand")
def capacity_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 4
    unit = facts.unit_multiplier(col.ladder([(F.col("p_type") == "ECONOMY", "thousand"), (F.col("p_type") == "PROMO", "Million ")], "each"))
    rows = ad.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), (F.col("p_retailprice") * unit).alias("v"), (F.col("p_retailprice") * col.ladder([(size == 0, 1.02), (size == 1, 1.08), (size == 2, 1.3)]) * unit).alias("w"))
    return reconcile.capacity_hits(rows, "v", "w", ["brand"])


_NAMED = """p0 AS (SELECT p_brand AS brand, CASE WHEN p_size % 10 = 0 THEN '가동률' WHEN p_size % 2 = 0 THEN 'capacity' ELSE 'output' END AS section, p_partkey AS k, p_name AS n, p_retailprice AS v, DATE '2020-03-31' + CAST(p_size % 4 AS INTEGER) * INTERVAL 3 MONTH AS d FROM part),
ll AS (SELECT brand, section, CASE k % 4 WHEN 0 THEN n || ' (kl)' WHEN 1 THEN split_part(n, ' ', 1) WHEN 2 THEN 'the ' || upper(n) || '부문' ELSE n END AS name, last_day(d) AS period, max(v) AS value, CASE k % 4 WHEN 0 THEN 'kl' END AS expected FROM p0 GROUP BY ALL),
rr AS (SELECT brand, section, CASE k % 5 WHEN 0 THEN n WHEN 1 THEN split_part(n, ' ', 1) || ' 합계' WHEN 2 THEN upper(n) || '-공장' WHEN 3 THEN split_part(n, ' ', 2) ELSE substr(n, 1, 5) END AS name, last_day(d) AS period, max(v / CASE WHEN k % 7 = 0 THEN 1000 ELSE 1 END) AS value, CASE WHEN k % 7 = 0 THEN '천개' WHEN k % 7 = 1 THEN '백만 원' WHEN k % 7 = 2 THEN '시간' WHEN k % 7 < 5 THEN '개, %' END AS unit FROM p0 GROUP BY ALL),
lk AS (SELECT brand, section, name, arg_max(value, (period, value)) AS want, {key_name} AS a FROM ll GROUP BY brand, section, name), rk AS (SELECT brand, section, name AS match, arg_max(value, (period, value, coalesce(unit, ''))) AS v, arg_max_null(unit, (period, value, coalesce(unit, ''))) AS u, max(period) AS p, {key_name} AS b FROM rr GROUP BY brand, section, name),
m0 AS (SELECT *, least(length(a), length(b)) AS overlap, instr(a, b) AS s FROM lk JOIN rk USING (brand, section) WHERE length(a) >= 2 AND length(b) >= 2 AND (contains(a, b) OR contains(b, a))),
m1 AS (SELECT * FROM m0 WHERE (s = 0 OR a = b OR substr(a, s + length(b), 1) IN ('', ' ') OR ((s = 1 OR substr(a, s - 1, 1) = ' ') AND length(b) / CASE WHEN strpos(substr(a, s + length(b)), ' ') > 0 THEN length(b) + strpos(substr(a, s + length(b)), ' ') - 1 ELSE length(a) - s + 1 END >= 0.6)) AND (overlap < 4 OR overlap / greatest(length(a), length(b)) >= 0.3)),
m2 AS (SELECT *, overlap = max(overlap) OVER (PARTITION BY brand, section, name) AS top, CASE WHEN section = '가동률' THEN v WHEN u = '천개' THEN v * 1000 WHEN u = '백만 원' THEN v * 1000000 ELSE v END AS w, month(p) AS mo FROM m1),
m3 AS (SELECT *, CASE WHEN top AND count_if(top) OVER (PARTITION BY brand, section, name) > 1 THEN least(abs(w - want), CASE WHEN mo IN (3, 6, 9) THEN abs(w * (12 / mo) - want) END, CASE WHEN mo IN (3, 6, 9) THEN abs(w / (mo // 3) - want) END) END AS near FROM m2),
mt AS (SELECT brand, section, name, match, overlap FROM m3 QUALIFY row_number() OVER (PARTITION BY brand, section, name ORDER BY near NULLS LAST, (regexp_matches(match, '합계|소계|총계') AND length(a) < 10) DESC, overlap DESC, match) = 1)""".replace("{key_name}", r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(name, '\s+', ' ', 'g')), '\s*부문$', '', 'g'), '\s*부문\s+', ' ', 'g'), '\s*\([^)]*\)', ' ', 'g'), '&cr|[-–—]|공장', ' ', 'g'), '\s+', ' ', 'g')))""")


def _named_products(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as the products of two sources that spell, sum and measure them differently."""
    n, k, size = F.col("p_name"), F.col("p_partkey"), F.col("p_size")
    word = lambda i: F.split_part(n, F.lit(" "), F.lit(i))
    section = F.when(size % 10 == 0, products.RATES).when(size % 2 == 0, "capacity").otherwise("output")
    period = F.last_day(F.add_months(F.lit(dt.date(2020, 3, 31)), (size % 4 * 3).cast("int")))
    part = ad.table(spark, sf_dir, "part")
    spelt = F.when(k % 4 == 0, F.concat(n, F.lit(" (kl)"))).when(k % 4 == 1, word(1)).when(k % 4 == 2, F.concat(F.lit("the "), F.upper(n), F.lit("부문"))).otherwise(n)
    left = part.groupBy(F.col("p_brand").alias("brand"), section.alias("section"), spelt.alias("name"), period.alias("period"), F.when(k % 4 == 0, "kl").alias("expected")).agg(F.max("p_retailprice").alias("value"))
    other = F.when(k % 5 == 0, n).when(k % 5 == 1, F.concat(word(1), F.lit(" 합계"))).when(k % 5 == 2, F.concat(F.upper(n), F.lit("-공장"))).when(k % 5 == 3, word(2)).otherwise(F.substring(n, 1, 5))
    unit = F.when(k % 7 == 0, "천개").when(k % 7 == 1, "백만 원").when(k % 7 == 2, "시간").when(k % 7 < 5, "개, %")
    right = part.groupBy(F.col("p_brand").alias("brand"), section.alias("section"), other.alias("name"), period.alias("period"), unit.alias("unit")).agg(F.max(F.col("p_retailprice") / F.when(k % 7 == 0, 1000).otherwise(1)).alias("value"))
    return left, right


@query(_NAMED, twin="SELECT * FROM mt")
def product_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.matched_products(*_named_products(spark, sf_dir), ["brand", "section"])


@query(_NAMED, "r1 AS (SELECT brand, section, name AS match, period, max(value) AS v, arg_max_null(unit, (value, coalesce(unit, ''))) AS u FROM rr GROUP BY ALL)", "h AS (SELECT section, l.value AS v, CASE WHEN section = '가동률' THEN r1.v WHEN u = '천개' THEN r1.v * 1000 WHEN u = '백만 원' THEN r1.v * 1000000 ELSE r1.v END AS w FROM ll l JOIN mt USING (brand, section, name) JOIN r1 USING (brand, section, match, period) WHERE section = '가동률' OR u IS NULL OR NOT (u = '시간' OR coalesce(expected, '') = 'kl' AND u = '백만 원'))",
    twin="SELECT section, count(w) AS matched, count_if(abs(v - w) / abs(v) <= 0.05) AS within_5, count_if(abs(v - w) / abs(v) <= 0.1) AS within_10, count_if(abs(v - w) / abs(v) <= 0.15) AS within_15 FROM h GROUP BY section")
def product_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _named_products(spark, sf_dir)
    keys = ["brand", "section"]
    return reconcile.capacity_hits(products.product_errors(left, right, products.matched_products(left, right, keys), keys), "value", "matched_value", ["section"])


_MODES = "e AS (SELECT ticker, metric, mode, CASE mode WHEN 'quarter' THEN CASE WHEN ticker % 3 = 0 THEN 0.01 ELSE 0.3 END ELSE CASE WHEN ticker % 3 = 0 THEN 0.2 WHEN ticker % 3 = 1 THEN 0.1 ELSE 0.25 END END * (1 + fiscal_quarter / 10.0) AS error FROM (SELECT ticker, fiscal_quarter, metric FROM stmts, (VALUES ('revenue'), ('cogs')) t(metric)), (VALUES ('quarter'), ('ttm')) u(mode))"


@query(STATEMENTS, _MODES, "m AS (SELECT ticker, metric, mode, median(error) AS m FROM e GROUP BY 1, 2, 3)", "v AS (SELECT *, min(m) OVER (PARTITION BY ticker, metric) AS a, max(m) OVER (PARTITION BY ticker, metric) AS z FROM m)",
    "c AS (SELECT ticker, mode, count(*) AS votes FROM v WHERE m = a AND m < 0.15 AND m < z / 2 GROUP BY 1, 2)", twin="SELECT ticker, mode, votes FROM c QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY votes DESC, mode DESC) = 1")
def best_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, each = F.col("ticker") % 3, lambda *v: F.explode(F.array(*map(F.lit, v)))
    rows = ad.statements(spark, sf_dir).select("ticker", "fiscal_quarter", each("revenue", "cogs").alias("metric")).withColumn("mode", each("quarter", "ttm"))
    error = F.when(F.col("mode") == "quarter", F.when(k == 0, 0.01).otherwise(0.3)).otherwise(F.when(k == 0, 0.2).when(k == 1, 0.1).otherwise(0.25)) * (1 + F.col("fiscal_quarter") / 10.0)
    return reconcile.best_mode(rows.withColumn("error", error), "ticker", "metric", "mode")


# fiscal sequences


@query(STATEMENTS, "a AS (SELECT ticker, period_end, fiscal_year, fiscal_quarter, fiscal_quarter = 2 AS an FROM stmts)", "b AS (SELECT *, min(CASE WHEN an THEN period_end END) OVER (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx, max(CASE WHEN an THEN period_end END) OVER (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv FROM a)",
    "c AS (SELECT *, row_number() OVER (PARTITION BY ticker, nx ORDER BY period_end DESC) AS bk, row_number() OVER (PARTITION BY ticker, pv, nx IS NULL ORDER BY period_end) AS fw FROM b)",
    "d AS (SELECT ticker, period_end, fiscal_year, fiscal_quarter, CASE WHEN nx IS NOT NULL AND date_diff('day', period_end, nx) <= 380 AND bk <= 4 THEN year(nx) - CASE WHEN month(nx) <= 5 OR (month(nx) = 6 AND day(nx) <= 7) THEN 1 ELSE 0 END WHEN nx IS NULL AND pv IS NOT NULL AND date_diff('day', pv, period_end) <= 380 AND fw <= 3 THEN year(pv) + 1 - CASE WHEN month(pv) <= 5 OR (month(pv) = 6 AND day(pv) <= 7) THEN 1 ELSE 0 END END AS y, CASE WHEN nx IS NOT NULL AND date_diff('day', period_end, nx) <= 380 AND bk <= 4 THEN 5 - bk WHEN nx IS NULL AND pv IS NOT NULL AND date_diff('day', pv, period_end) <= 380 AND fw <= 3 THEN fw END AS q FROM c)",
    twin="SELECT ticker, period_end, CAST(coalesce(y, fiscal_year) AS INTEGER) AS fiscal_year, CAST(coalesce(q, fiscal_quarter) AS INTEGER) AS fiscal_quarter, y IS NOT NULL AS anchored, coalesce(y <> fiscal_year OR q <> fiscal_quarter, FALSE) AS shifted FROM d")
def anchored_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir).select("ticker", "period_end", "fiscal_year", "fiscal_quarter", (F.col("fiscal_quarter") == 2).alias("is_annual"))
    out = facts.anchored_quarters(rows).drop("is_annual")
    return out.withColumns({c: F.col(c).cast("int") for c in ("fiscal_year", "fiscal_quarter")})


@query(STATEMENTS, "f AS (SELECT ticker, period_end, fiscal_quarter, revenue, CASE WHEN fiscal_quarter = 4 AND fiscal_year <= 1996 THEN 'FY' ELSE form END AS form FROM stmts)", "g AS (SELECT *, max(CASE WHEN form = 'FY' AND fiscal_quarter = 4 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY period_end) AS genuine FROM f)",
    twin="SELECT ticker, period_end, revenue FROM g WHERE genuine = 1")
def leading_annual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir).withColumn("form", F.when((F.col("fiscal_quarter") == 4) & (F.col("fiscal_year") <= 1996), "FY").otherwise(F.col("form")))
    return st.drop_leading_annual(rows).select("ticker", "period_end", "revenue")


# memberships and audits


@query(EVENTS, _INTERVALS, twin="SELECT ticker, valid_from AS date, 'add' AS action FROM iv UNION ALL SELECT ticker, valid_to + 1, 'remove' FROM iv WHERE valid_to IS NOT NULL")
def intervals_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intervals_to_events(_intervals(spark, sf_dir), ["ticker"])


@query(EVENTS, _INTERVALS, twin="SELECT DISTINCT ticker FROM iv WHERE valid_from <= DATE '1996-12-31' AND coalesce(valid_to, DATE '9999-12-31') >= DATE '1996-06-01'")
def active_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    return intervals.active(_intervals(spark, sf_dir), "ticker", day("1996-06-01"), day("1996-12-31"))


_WIDER = "wv AS (SELECT ticker, valid_from, CASE WHEN valid_to IS NOT NULL THEN valid_to + CAST(ticker % 90 AS INTEGER) END AS valid_to FROM iv)"


@query(EVENTS, _INTERVALS, _WIDER, "r AS (SELECT *, max(coalesce(valid_to, DATE '9999-12-31')) OVER (PARTITION BY ticker ORDER BY valid_from, coalesce(valid_to, DATE '9999-12-31') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wv)",
    twin="SELECT ticker, valid_from, valid_to FROM r WHERE valid_from <= reach")
def overlapping_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wider = _intervals(spark, sf_dir).withColumn("valid_to", F.date_add("valid_to", (F.col("ticker") % 90).cast("int")))
    return intervals.overlaps(wider, ["ticker"])


@query(EVENTS, _INTERVALS, twin="""SELECT DISTINCT coalesce('security_id:' || CASE WHEN ticker % 3 = 0 THEN CAST(ticker AS VARCHAR) END, 'ticker:T' || ticker) AS member, 'exchange' AS kind, 'X' || (ticker % 4) AS code, valid_from, valid_to, 'exchanges' AS source FROM iv
 UNION SELECT coalesce('company_id:' || CASE WHEN ticker % 5 = 0 THEN CAST(ticker AS VARCHAR) END, 'ticker:T' || ticker), 'index', 'I1', valid_from, valid_to, 'indexes' FROM iv""")
def unified_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = _intervals(spark, sf_dir), F.col("ticker")
    name = F.concat(F.lit(" t"), k.cast("string"))
    one = rows.select(F.when(k % 3 == 0, k).alias("security_id"), name.alias("ticker"), F.concat(F.lit("X"), (k % 4).cast("string")).alias("exchange"), F.col("valid_from").alias("first_date"), F.col("valid_to").alias("last_date"))
    two = rows.select(F.lit("I1").alias("index_code"), name.alias("ticker"), F.when(k % 5 == 0, k).alias("company_id"), F.col("valid_from").alias("start"), F.col("valid_to").alias("end"))
    return intervals.unified_memberships(one.unionByName(one), two)


@query(EVENTS, twin="""SELECT issue, count(*) AS n, CASE issue WHEN 'reversed' THEN 'fail' ELSE 'warn' END AS severity FROM (SELECT CASE WHEN action = 'remove' AND coalesce(prev = 'remove', TRUE) THEN 'remove_without_add' WHEN action = 'add' AND nxt - 1 < date THEN 'reversed' END AS issue FROM (
 SELECT *, lag(action) OVER w AS prev, lead(date) OVER w AS nxt FROM events_m WINDOW w AS (PARTITION BY ticker ORDER BY date, CASE action WHEN 'remove' THEN 0 ELSE 1 END, event_id))) WHERE issue IS NOT NULL GROUP BY issue""")
def membership_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = intervals.event_issues(ad.membership_events(spark, sf_dir), ["ticker"])
    return intervals.issue_counts(issues, severity={"reversed": "fail", "remove_without_add": "warn"})


@query(EVENTS, _INTERVALS, "c AS (SELECT ticker, (ticker % 10) / 10.0 AS conf, CASE WHEN ticker % 4 <> 0 THEN 'p' END AS prov FROM iv)",
    twin="""SELECT count(*) AS n, round(avg(CAST(conf < 0.5 AS INTEGER)), 6) AS low_confidence_rate, round(avg(CAST(prov IS NULL AS INTEGER)), 6) AS missing_provenance_rate, round((SELECT avg(CAST(n > 1 AS INTEGER)) FROM (SELECT count(*) AS n FROM c GROUP BY ticker)), 6) AS multi_interval_rate, round(min(conf), 6) AS least, round(max(conf), 6) AS most, round(avg(conf), 6) AS mean,
 round(quantile_cont(conf, 0.1), 6) AS p10, round(quantile_cont(conf, 0.5), 6) AS median, round(quantile_cont(conf, 0.9), 6) AS p90 FROM c""")
def interval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _intervals(spark, sf_dir).withColumns({"conf": (F.col("ticker") % 10) / 10.0, "prov": F.when(F.col("ticker") % 4 != 0, "p")})
    out = quality.interval_quality(rows, "ticker", "conf", "prov")
    return out.select("n", *(F.round(c, 6).alias(c) for c in out.columns if c != "n"))


@query(_ORDERS, EVENTS, _INTERVALS, "lv AS (SELECT ticker, valid_from, valid_to + 40 AS valid_to, CASE ticker % 3 WHEN 0 THEN 'unknown' ELSE 's' || (day(valid_from) % 2) END AS sector FROM iv)",
    "h AS (SELECT t.k, t.priority, count(DISTINCT lv.sector) AS n, bool_or(lv.sector = 'unknown') AS u FROM od t LEFT JOIN lv ON lv.ticker = t.ticker AND lv.valid_from <= t.date AND coalesce(lv.valid_to, DATE '9999-12-31') >= t.date GROUP BY 1, 2)",
    twin="SELECT priority, count(*) AS n, round(avg(CAST(n = 0 AS INTEGER)), 6) AS missing_rate, round(avg(CAST(coalesce(u, FALSE) AS INTEGER)), 6) AS unclassified_rate, round(avg(CAST(n > 1 AS INTEGER)), 6) AS conflict_rate FROM h GROUP BY priority")
def classification_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ticker") % 3
    rows = _intervals(spark, sf_dir).withColumns({"valid_to": F.date_add("valid_to", 40), "sector": F.when(k == 0, "unknown").otherwise(F.concat(F.lit("s"), (F.dayofmonth("valid_from") % 2).cast("string")))})
    out = quality.classification_audit(_orders(spark, sf_dir), rows, "ticker", "date", "sector", ["priority"])
    return out.select("priority", "n", *(F.round(c, 6).alias(c) for c in ("missing_rate", "unclassified_rate", "conflict_rate")))


@query(EVENTS, twin="SELECT 'action' AS dimension, action AS value, count(*) AS n FROM events_m GROUP BY action UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR), count(*) FROM events_m GROUP BY year(date)")
def event_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.event_statistics(ad.membership_events(spark, sf_dir).withColumn("year", F.year("date")), "action", "year")


@query(_ORDERS, twin="SELECT ticker, k, side FROM (SELECT ticker, k, 'expected' AS side FROM od WHERE status <> 'F' AND k NOT IN (SELECT k FROM od WHERE status <> 'O') UNION ALL SELECT ticker, k, 'found' FROM od WHERE status <> 'O' AND k NOT IN (SELECT k FROM od WHERE status <> 'F'))")
def missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    return quality.missing_rows(rows.where("status <> 'F'"), rows.where("status <> 'O'"), ["ticker", "k"])


@query(_ORDERS, "s AS (SELECT ticker, CASE WHEN status = 'P' THEN NULL ELSE value END AS v FROM od)", "a AS (SELECT ticker, count(*) AS n, max(CAST(v IS NULL AS INTEGER)) AS z FROM s GROUP BY ticker)", "b AS (SELECT ticker, count(*) AS n FROM od WHERE priority > 1 GROUP BY ticker)",
    twin="SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.n, 0) AS n_snapshot, coalesce(z, 0) AS columns_with_nulls, coalesce(b.n, 0) AS n_log, 0 AS missing_columns, CASE WHEN coalesce(a.n, 0) <> coalesce(b.n, 0) THEN 'fail' WHEN coalesce(z, 0) > 0 THEN 'warn' ELSE 'pass' END AS status FROM a FULL JOIN b ON b.ticker = a.ticker")
def snapshot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    snapshots = rows.select("ticker", F.when(F.col("status") != "P", F.col("value")).alias("v"))
    return quality.snapshot_audit(snapshots, rows.where("priority > 1"), ["ticker"], ["ticker", "v"])


@query(STATEMENTS, "t AS (SELECT ticker, CASE WHEN fiscal_quarter % 2 = 0 THEN 'sell' ELSE 'buy' END AS side, revenue AS notional, CASE WHEN fiscal_quarter % 2 = 0 THEN net_income END AS pnl FROM stmts)",
    twin="SELECT t.ticker, round(sum(abs(notional)) / (SELECT avg(assets) FROM stmts s WHERE s.ticker = t.ticker), 6) AS turnover, round(avg(CASE WHEN side = 'sell' THEN CAST(pnl > 0 AS INTEGER) END), 6) AS hit_rate, sum(pnl) AS pnl FROM t GROUP BY t.ticker")
def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, even = ad.statements(spark, sf_dir), F.col("fiscal_quarter") % 2 == 0
    trades = rows.select("ticker", F.when(even, "sell").otherwise("buy").alias("side"), F.col("revenue").alias("notional"), F.when(even, F.col("net_income")).alias("realized_pnl"), F.col("assets").alias("equity"))
    out = perf.trade_metrics(trades, None, ["ticker"])
    return out.select("ticker", F.round("turnover", 6).alias("turnover"), F.round("hit_rate", 6).alias("hit_rate"), "pnl")


@query(STATEMENTS, "v AS (SELECT ticker, metric, fiscal_quarter AS q, period_end, value FROM stmts UNPIVOT (value FOR metric IN (revenue, cogs)))", twin="SELECT ticker, metric, count(DISTINCT period_end) AS periods, count(DISTINCT q) AS sources FROM v GROUP BY 1, 2")
def temporal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.temporal_consistency(ad.facts(spark, sf_dir, "revenue", "cogs"), ["ticker", "metric"], "period_end", "fiscal_quarter")


# whole jobs


_SEGMENTS = """sg AS (SELECT ticker, fiscal_quarter % 2 AS segment, period_end, 'filing' AS source, revenue AS value, 1 AS rank FROM stmts WHERE fiscal_quarter <> 3 UNION ALL SELECT ticker, fiscal_quarter % 2, period_end, 'filing', revenue * 2, 2 FROM stmts WHERE fiscal_quarter <> 3
 UNION ALL SELECT ticker, fiscal_quarter % 2, period_end, 'other', CASE WHEN ticker % 2 = 0 THEN revenue ELSE revenue * 1.2 END, 1 FROM stmts WHERE fiscal_quarter <> 2)"""


@query(STATEMENTS, _SEGMENTS, "b AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY ticker, segment, period_end, source ORDER BY rank, value DESC) = 1)",
    "c AS (SELECT ticker, segment, count_if(source = 'filing') AS rf, count_if(source = 'other') AS ro, count(DISTINCT CASE WHEN source = 'filing' THEN period_end END) AS pf, count(DISTINCT CASE WHEN source = 'other' THEN period_end END) AS po, count(DISTINCT period_end) AS periods, count(DISTINCT source) AS sources FROM b GROUP BY 1, 2)",
    "o AS (SELECT ticker, segment, count(*) AS compared, count_if(z - a <= 0.05 * greatest(m, 1)) AS agreeing FROM (SELECT ticker, segment, period_end, max(value) AS z, min(value) AS a, max(abs(value)) AS m, count(DISTINCT source) AS n FROM b GROUP BY 1, 2, 3) WHERE n > 1 GROUP BY 1, 2)",
    twin="""SELECT c.ticker, c.segment, rf AS rows_filing, ro AS rows_other, CAST(coalesce(compared, 0) AS INTEGER) AS overlap, CASE WHEN coalesce(compared, 0) >= 4 THEN 'overlap' WHEN pf >= 4 THEN 'filing_only' WHEN pf >= 2 OR po >= 2 THEN 'partial' ELSE 'poor' END AS cluster, periods, sources, coalesce(compared, 0) AS compared, coalesce(agreeing, 0) AS agreeing,
 CASE WHEN coalesce(compared, 0) = 0 THEN 'not_compared' WHEN agreeing = compared THEN 'match' ELSE 'breach' END AS status FROM c LEFT JOIN o ON o.ticker = c.ticker AND o.segment = c.segment""")
def segment_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = ad.statements(spark, sf_dir), F.col("fiscal_quarter")
    part = lambda source, value, rank, no: rows.where(q != no).select("ticker", (q % 2).alias("segment"), "period_end", F.lit(source).alias("source"), value.alias("value"), F.lit(rank).alias("rank"))
    v = F.col("revenue")
    every = part("filing", v, 1, 3).unionByName(part("filing", v * 2, 2, 3)).unionByName(part("other", F.when(F.col("ticker") % 2 == 0, v).otherwise(v * 1.2), 1, 2))
    return jobs.segment_reconciliation(every, ["filing", "other"])


@query(STATEMENTS, "y AS (SELECT *, sum(revenue) OVER (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter) AS ytd, lag(revenue) OVER (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter) AS has FROM stmts)",
    twin="""SELECT 'companies' AS relation, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS ticker, NULL AS fiscal_year, NULL AS fiscal_quarter, CAST(NULL AS DOUBLE) AS value, CASE s_nationkey % 3 WHEN 0 THEN 'prime' WHEN 1 THEN 'growth' ELSE 'other' END AS tier FROM supplier
 UNION ALL SELECT 'quarterly', lpad(CAST(ticker AS VARCHAR), 6, '0'), fiscal_year, fiscal_quarter, CASE WHEN fiscal_quarter = 1 OR has IS NOT NULL THEN revenue ELSE revenue END, NULL FROM y UNION ALL SELECT 'annual', lpad(CAST(ticker AS VARCHAR), 6, '0'), fiscal_year, NULL, ytd, NULL FROM y WHERE fiscal_quarter = 4""")
def second_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    isin = lambda c: F.concat(F.lit("KR7"), F.lpad(F.col(c).cast("string"), 6, "0"), F.lit("003"))
    s, rows = ad.table(spark, sf_dir, "supplier"), ad.statements(spark, sf_dir)
    master = s.select(isin("s_suppkey").alias("isin"), F.col("s_name").alias("name"), col.ladder([(F.col("s_nationkey") % 3 == 0, "Tier 1"), (F.col("s_nationkey") % 3 == 1, "tier 2")], "?").alias("tier"))
    own = rows.select(isin("ticker").alias("isin"), "fiscal_year", "fiscal_quarter", F.lit("KRW").alias("currency"), F.sum("revenue").over(win.by("ticker", "fiscal_year", order="fiscal_quarter")).alias("ytd"), F.col("revenue").alias("quarter"))
    foreign = own.withColumn("currency", F.lit("USD"))
    out = jobs.second_market_tables(master, own.unionByName(foreign), {"tier 1": "prime", "tier 2": "growth"}, "KRW")
    return quality.survey([df.withColumn("relation", F.lit(name)) for name, df in out.items()]).select("relation", "ticker", "fiscal_year", "fiscal_quarter", "value", "tier")


_ROWS = "rw AS (SELECT ticker, fiscal_year, fiscal_quarter, 'R' || (ticker % 2) AS account_id, CASE WHEN ticker % 2 = 0 THEN 'x' ELSE 'Net  Sales' END AS account_name, 1 AS ord, sum(revenue) OVER (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter) AS value FROM stmts UNION ALL SELECT ticker, fiscal_year, fiscal_quarter, 'Z', 'total sales of goods', 2, 1.0 FROM stmts UNION ALL SELECT ticker, fiscal_year, fiscal_quarter, 'Z', 'other', 3, 2.0 FROM stmts)"


@query(STATEMENTS, "t AS (SELECT ticker, fiscal_year, fiscal_quarter, sum(revenue) OVER (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter) AS x FROM stmts)", "y AS (SELECT ticker, fiscal_year, max(CASE WHEN fiscal_quarter = 1 THEN x END) AS a, max(CASE WHEN fiscal_quarter = 2 THEN x END) AS b, max(CASE WHEN fiscal_quarter = 3 THEN x END) AS c, max(CASE WHEN fiscal_quarter = 4 THEN x END) AS d FROM t GROUP BY 1, 2)",
    "z AS (SELECT *, CASE WHEN d > coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AND coalesce(a, b, c) IS NOT NULL THEN d - (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) ELSE d END AS dd FROM y)",
    "p AS (SELECT *, coalesce(CAST(b - a < 0 AS INTEGER), 0) + coalesce(CAST(c - b < 0 AS INTEGER), 0) + coalesce(CAST(d - c < 0 AS INTEGER), 0) + coalesce(CAST(a < 0 AS INTEGER), 0) + coalesce(CAST(abs(d - c) > 3 * greatest(abs(a), abs(b - a), abs(c - b)) AS INTEGER), 0) AS pr, coalesce(CAST(dd < 0 AS INTEGER), 0) + coalesce(CAST(a < 0 AS INTEGER), 0) + coalesce(CAST(b < 0 AS INTEGER), 0) + coalesce(CAST(c < 0 AS INTEGER), 0) + coalesce(CAST(abs(dd) > 3 * greatest(abs(a), abs(b), abs(c)) AS INTEGER), 0) AS pd FROM z)",
    twin="SELECT ticker, 'sales' AS metric, fiscal_year, a AS q1, CASE WHEN pr < pd THEN b - a ELSE b END AS q2, CASE WHEN pr < pd THEN c - b ELSE c END AS q3, CASE WHEN pr < pd THEN d - c ELSE dd END AS q4, CASE WHEN pr < pd THEN 'running' ELSE 'direct' END AS mode FROM p")
def accounts_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir)
    part = lambda id_, name, n, value: rows.select("ticker", "fiscal_year", "fiscal_quarter", id_.alias("account_id"), name.alias("account_name"), F.lit(n).alias("ord"), value.alias("value"))
    odd = F.col("ticker") % 2
    main = part(F.concat(F.lit("R"), odd.cast("string")), F.when(odd == 0, "x").otherwise("Net  Sales"), 1, F.sum("revenue").over(win.by("ticker", "fiscal_year", order="fiscal_quarter")))
    every = main.unionByName(part(F.lit("Z"), F.lit("total sales of goods"), 2, F.lit(1.0))).unionByName(part(F.lit("Z"), F.lit("other"), 3, F.lit(2.0)))
    ids = spark.createDataFrame([("R0", "sales")], "id string, metric string")
    names = spark.createDataFrame([("netsales", "sales")], "name string, metric string")
    patterns = spark.createDataFrame([(1, "sales", "sales")], "rank int, pattern string, metric string")
    return jobs.accounts_to_quarters(every, ids, names, patterns, ["sales"])


@query(_ORDERS, EVENTS, _INTERVALS, "lk AS (SELECT ticker AS security, ticker % 50 AS entity, valid_from, valid_to FROM iv)", "nm AS (SELECT ticker AS security, 'n' || min(event_id) AS name, min(date) AS valid_from, CAST(NULL AS DATE) AS valid_to FROM events_m GROUP BY ticker)",
    "h AS (SELECT l.security, entity, name, greatest(l.valid_from, n.valid_from) AS valid_from, l.valid_to FROM lk l JOIN nm n ON n.security = l.security AND coalesce(l.valid_to, DATE '9999-12-31') >= n.valid_from)",
    twin="""SELECT 'history' AS relation, entity, security, valid_from AS d, name, NULL AS k FROM h UNION ALL SELECT 'entities', entity, security, valid_from, name, NULL FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY entity ORDER BY valid_from DESC, security) = 1)
 UNION ALL SELECT 'daily', l.entity, t.ticker, t.date, NULL, t.k FROM od t LEFT JOIN lk l ON l.security = t.ticker AND l.valid_from <= t.date AND coalesce(l.valid_to, DATE '9999-12-31') >= t.date""")
def canonical_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _intervals(spark, sf_dir).select(F.col("ticker").alias("security"), (F.col("ticker") % 50).alias("entity"), F.lit(True).alias("primary"), "valid_from", "valid_to")
    names = ad.membership_events(spark, sf_dir).groupBy(F.col("ticker").alias("security")).agg(F.concat(F.lit("n"), F.min("event_id").cast("string")).alias("name"), F.min("date").alias("valid_from")).withColumn("valid_to", F.lit(None).cast("date"))
    daily = _orders(spark, sf_dir).select("k", F.col("ticker").alias("security"), "date")
    out = jobs.canonical_tables(links, names, daily)
    own = lambda name, d: out[name].select(F.lit(name).alias("relation"), "entity", "security", F.col(d).alias("d"), *([F.col(c) for c in ("name", "k") if c in out[name].columns]))
    return quality.survey([own("history", "valid_from"), own("entities", "valid_from"), own("daily", "date")])


@query(STATEMENTS, BARS, "x AS (SELECT s.ticker, s.period_end, CASE WHEN fiscal_quarter = 1 THEN NULL ELSE revenue END AS rev, cogs, revenue - cogs AS gp, operating_income AS oi, CASE WHEN fiscal_quarter = 2 THEN NULL ELSE net_income + interest END AS pre, CASE WHEN fiscal_quarter = 2 THEN NULL ELSE interest END AS tax, net_income AS net, cfo, capex, CASE WHEN fiscal_quarter = 3 THEN NULL ELSE payables END AS sd, debt AS ld, receivables AS o1 FROM stmts s)",
    twin="""SELECT x.ticker, x.period_end, coalesce(rev, cogs + gp) AS revenue, coalesce(pre, net + tax) AS pretax, coalesce(tax, coalesce(pre, net + tax) - net) AS tax, coalesce(coalesce(pre, net + tax) - oi, o1) AS non_operating, cfo - abs(capex) AS fcf, coalesce(sd, 0) + ld AS debt, b.close AS price FROM x ASOF LEFT JOIN bars b ON b.ticker = x.ticker AND x.period_end >= b.date""")
def base_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, rows = F.col("fiscal_quarter"), ad.statements(spark, sf_dir)
    rows = rows.withColumns({"Sales": F.when(q != 1, F.col("revenue")), "gp": F.col("revenue") - F.col("cogs"), "pre": F.when(q != 2, F.col("net_income") + F.col("interest")), "tax_": F.when(q != 2, F.col("interest")), "sd": F.when(q != 3, F.col("payables"))})
    names = {"revenue": ["Net sales", "Sales"], "cogs": ["cogs"], "gross": ["gp"], "operating_income": ["operating_income"], "pretax": ["pre"], "tax": ["tax_"], "net_income": ["net_income"], "cfo": ["cfo"], "capex": ["capex"], "short_debt": ["sd"], "long_debt": ["debt"], "other_1": ["receivables"], "other_2": ["none"]}
    out = jobs.base_frame(rows, names, ad.prices(spark, sf_dir))
    return out.select("ticker", "period_end", "revenue", "pretax", "tax", "non_operating", "fcf", "debt", "price")


@query(STATEMENTS, "l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS n FROM stmts)", "m AS (SELECT ticker, period_end, n, metric, value FROM (SELECT ticker, period_end, n, revenue, equity FROM l) UNPIVOT (value FOR metric IN (revenue, equity)))",
    twin="SELECT ticker, period_end, metric, value, round(yoy, 4) AS yoy FROM (SELECT *, (value / lag(value, 4) OVER (PARTITION BY ticker, metric ORDER BY period_end) - 1) * 100 AS yoy FROM m) WHERE n <= 5")
def kpi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.kpi_rows(ad.statements(spark, sf_dir), ["revenue", "equity"])
    return out.select("ticker", "period_end", "metric", "value", F.round("yoy", 4).alias("yoy"))


@query(BARS, "m AS (SELECT max(date) AS d FROM bars GROUP BY date_trunc('month', date))", "c AS (SELECT b.*, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before FROM bars b)", "s AS (SELECT ticker, date, round(100 * percent, 9) AS score FROM (SELECT ticker, date, (rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS percent FROM bars WHERE date IN (SELECT d FROM m)))",
    twin="SELECT date, ticker, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS INTEGER) AS rank, round(1.0 / least(10, count(*) OVER (PARTITION BY date)), 9) AS weight FROM s QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= 10")
def rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pl.screen_dates(ad.prices(spark, sf_dir), "month", "", {"close": (1.0, True)}, 10)
    return out.select("date", "ticker", F.col("rank").cast("int").alias("rank"), F.round("weight", 9).alias("weight"))


@query(BARS, twin="SELECT count(*) > 0 AS momentum_21, FALSE AS per, TRUE AS dollar_volume_20d FROM (SELECT lag(close, 21) OVER (PARTITION BY ticker ORDER BY date) AS x FROM bars) WHERE x IS NOT NULL")
def metric_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["momentum_21", "per", "dollar_volume_20d"]
    return pl.availability_map(pl.with_metrics(ad.prices(spark, sf_dir), names), names)


# coverage of issuers

_SURVEYED = """fr AS (SELECT ticker, period_end, fiscal_quarter, metric, value, 'filing' AS family, CASE WHEN fiscal_quarter % 2 = 0 AND ticker % 3 > 0 THEN 'html' ELSE 'xbrl' END AS source, CASE WHEN ticker % 4 = 0 THEN 'business' WHEN (ticker + fiscal_quarter) % 4 = 0 THEN 'geography' WHEN (ticker + fiscal_quarter) % 4 = 1 THEN 'product' WHEN (ticker + fiscal_quarter) % 4 = 2 THEN 'business' ELSE 'legal' END AS segment_type
  FROM stmts UNPIVOT (value FOR metric IN (revenue, operating_income)) WHERE ticker % 5 < 4 AND (metric = 'revenue' OR ticker % 2 = 0) AND (ticker % 5 < 3 OR fiscal_year = 1996 AND fiscal_quarter <= 1 + ticker % 4)),
cr AS (SELECT ticker, period_end, fiscal_quarter, metric, value * CASE WHEN fiscal_quarter = 1 THEN 1.015 WHEN fiscal_quarter = 2 THEN 1.5 ELSE 1 END AS value, 'companyfacts' AS family, 'api' AS source, 'business' AS segment_type FROM stmts UNPIVOT (value FOR metric IN (revenue)) WHERE ticker % 6 = 0),
iss AS (SELECT s_suppkey AS ticker FROM supplier), pr AS (SELECT * FROM fr UNION ALL SELECT * FROM cr),
ct AS (SELECT ticker, count_if(family = 'filing') AS f, count_if(family = 'companyfacts') AS c, count(DISTINCT CASE WHEN family = 'filing' THEN period_end END) AS fp, count(DISTINCT CASE WHEN family = 'companyfacts' THEN period_end END) AS cp, count(DISTINCT CASE WHEN family = 'filing' AND metric = 'revenue' THEN period_end END) AS rp, count(DISTINCT CASE WHEN family = 'filing' AND metric = 'operating_income' THEN period_end END) AS op,
  count(DISTINCT CASE WHEN family = 'filing' THEN source END) AS src, count_if(family = 'filing' AND segment_type = 'business') AS b, count_if(family = 'filing' AND segment_type = 'geography') AS g, count_if(family = 'filing' AND segment_type = 'product') AS p, count_if(family = 'filing' AND segment_type = 'legal') AS o FROM pr GROUP BY ticker),
ov AS (SELECT ticker, count(*) AS ov FROM (SELECT DISTINCT ticker, period_end FROM fr INTERSECT SELECT DISTINCT ticker, period_end FROM cr) GROUP BY ticker),
c0 AS (SELECT ticker, coalesce(f, 0) AS f, coalesce(c, 0) AS c, coalesce(fp, 0) AS fp, coalesce(cp, 0) AS cp, coalesce(ov, 0) AS ov, coalesce(rp, 0) AS rp, coalesce(op, 0) AS op, coalesce(src, 0) AS src, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(p, 0) AS p, coalesce(o, 0) AS o FROM iss LEFT JOIN ct USING (ticker) LEFT JOIN ov USING (ticker)),
c1 AS (SELECT *, CASE WHEN c > 0 AND f > 0 AND ov > 0 THEN 'companyfacts_overlap' WHEN f > 0 AND c = 0 AND fp >= 4 THEN 'filing_only' WHEN f > 0 AND c = 0 AND fp >= 2 THEN 'filing_only_partial' ELSE 'segment_source_poor' END AS source_cluster,
  CASE WHEN rp >= 4 AND op >= 2 THEN 'revenue_and_operating_income' WHEN rp >= 2 AND op = 0 THEN 'revenue_only' WHEN rp >= 2 THEN 'revenue_primary' ELSE 'metric_sparse' END AS metric_cluster,
  CASE WHEN b + g + p + o = 0 THEN 'none' WHEN greatest(b, g, p, o) / (b + g + p + o) < 0.6 THEN 'mixed' WHEN b = greatest(b, g, p, o) THEN 'business_dominant' WHEN g = greatest(b, g, p, o) THEN 'geography_dominant' WHEN p = greatest(b, g, p, o) THEN 'product_dominant' ELSE 'other_dominant' END AS segment_profile FROM c0),
c2 AS (SELECT *, CASE WHEN source_cluster = 'filing_only' AND metric_cluster = 'revenue_only' THEN 'filing_only_revenue_only' WHEN source_cluster = 'filing_only' THEN 'filing_only_full' ELSE source_cluster END AS issuer_cluster, CASE ticker % 7 WHEN 0 THEN 'FileNotFoundError: x' WHEN 1 THEN 'instance_fetch_or_parse_failed' WHEN 2 THEN 'ok' WHEN 3 THEN 'index_fetch_failed' WHEN 4 THEN 'segment_not_found' END AS why FROM c1),
c3 AS (SELECT *, CASE WHEN issuer_cluster = 'segment_source_poor' AND f = 0 THEN CASE ticker % 7 WHEN 0 THEN 'filing_cache_missing' WHEN 1 THEN 'filing_present_but_xbrl_instance_missing' WHEN 2 THEN 'html_only_low_confidence_candidate' WHEN 3 THEN 'filing_cache_incomplete' WHEN 4 THEN 'filing_present_but_segment_not_disclosed' WHEN 5 THEN 'parser_candidate_but_not_materialized' ELSE 'source_unavailable' END END AS source_poor_reason FROM c2),
c4 AS (SELECT *, CASE WHEN source_poor_reason = 'parser_candidate_but_not_materialized' THEN 'filings_present_without_segment_rows' WHEN source_poor_reason = 'source_unavailable' THEN 'no_filing_meta_or_segment_logs' WHEN source_poor_reason IS NOT NULL THEN why END AS poor_reason_detail, coalesce(source_poor_reason = 'parser_candidate_but_not_materialized', FALSE) AS parser_candidate,
  list_filter([CASE WHEN c = 0 AND f > 0 THEN 'companyfacts_missing_filing_present' END, CASE WHEN ov = 0 AND c > 0 AND f > 0 THEN 'no_companyfacts_filing_overlap' END, CASE WHEN rp > 0 AND op = 0 THEN 'operating_income_sparse' END, CASE WHEN src <= 1 AND f > 0 THEN 'single_filing_source' END, CASE WHEN segment_profile LIKE '%\\_dominant' ESCAPE '\\' THEN 'segment_type_' || segment_profile END, 'source_poor_' || source_poor_reason, CASE WHEN c = 0 AND f = 0 THEN 'segment_source_missing' END], lambda x: x IS NOT NULL) AS codes FROM c3)"""


def _segment_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of filings and of a second source, with gaps, so that every cluster has issuers."""
    long = ad.facts(spark, sf_dir, "revenue", "operating_income")
    t, q, revenue = F.col("ticker"), F.col("fiscal_quarter"), F.col("metric") == "revenue"
    filed = long.where((t % 5 < 4) & (revenue | (t % 2 == 0)) & ((t % 5 < 3) | ((F.col("fiscal_year") == 1996) & (q <= 1 + t % 4))))
    kind = F.when(t % 4 == 0, "business").otherwise(F.element_at(F.array(*map(F.lit, ("geography", "product", "business", "legal"))), ((t + q) % 4 + 1).cast("int")))
    filed = filed.select("ticker", "period_end", "metric", "value", F.lit("filing").alias("family"), F.when((q % 2 == 0) & (t % 3 > 0), "html").otherwise("xbrl").alias("source"), kind.alias("segment_type"))
    second = long.where(revenue & (t % 6 == 0)).select("ticker", "period_end", "metric", (F.col("value") * F.when(q == 1, 1.015).when(q == 2, 1.5).otherwise(1.0)).alias("value"), F.lit("companyfacts").alias("family"), F.lit("api").alias("source"), F.lit("business").alias("segment_type"))
    return filed, second


def _survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed, second = _segment_rows(spark, sf_dir)
    issuers = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"))
    counts = coverage.issuer_counts(filed.unionByName(second))
    every = issuers.join(counts, "ticker", "left").fillna(0, [c for c in counts.columns if c != "ticker"])
    k = F.col("ticker") % 7
    why = F.when(k == 0, "FileNotFoundError: x").when(k == 1, "instance_fetch_or_parse_failed").when(k == 2, "ok").when(k == 3, "index_fetch_failed").when(k == 4, "segment_not_found")
    log = issuers.where(k < 5).select("ticker", why.alias("reason"), F.when(k == 2, "html_table_mvp").otherwise("xbrl_instance").alias("method"), F.when(k == 2, "Success").otherwise("fail").alias("status"))
    out = coverage.with_poor_reason(coverage.with_clusters(every), log, issuers.where(k == 5))
    return out.withColumn("codes", coverage.reason_codes())


@query(STATEMENTS, _SURVEYED, twin="SELECT ticker, f AS filing_rows, c AS companyfacts_rows, fp AS filing_periods, cp AS companyfacts_periods, ov AS overlap_periods, rp AS filing_revenue_periods, op AS filing_operating_income_periods, src AS filing_sources, b AS business_rows, g AS geography_rows, p AS product_rows, o AS other_rows, source_cluster, metric_cluster, segment_profile, issuer_cluster, source_poor_reason, poor_reason_detail, parser_candidate, codes FROM c4")
def issuer_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survey(spark, sf_dir)


@query(STATEMENTS, _SURVEYED, "e AS (SELECT 'issuer_cluster' AS dimension, issuer_cluster AS value FROM c4 UNION ALL SELECT 'metric_cluster', metric_cluster FROM c4 UNION ALL SELECT 'segment_profile', segment_profile FROM c4 UNION ALL SELECT 'source_poor_reason', source_poor_reason FROM c4 UNION ALL SELECT 'codes', unnest(codes) FROM c4)",
    twin="SELECT dimension, value, count(*) AS n, round(count(*) / (SELECT count(*) FROM c4), 6) AS rate FROM e WHERE value IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'total', name, CAST(sum(v) AS BIGINT), NULL FROM c4 UNPIVOT (v FOR name IN (rp, op, b)) GROUP BY name UNION ALL SELECT 'issuers', name, CAST(count_if(v > 0) AS BIGINT), NULL FROM c4 UNPIVOT (v FOR name IN (rp, op, b)) GROUP BY name")
def coverage_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    survey = _survey(spark, sf_dir)
    spread = coverage.distributions(survey, ["issuer_cluster", "metric_cluster", "segment_profile", "source_poor_reason"], ["codes"]).withColumn("rate", F.round("rate", 6))
    short = {"filing_revenue_periods": "rp", "filing_operating_income_periods": "op", "business_rows": "b"}
    held = coverage.support(survey.withColumnsRenamed(short), list(short.values()))
    own = lambda c, name: held.select(F.lit(name).alias("dimension"), F.col("name").alias("value"), F.col(c).alias("n"), F.lit(None).cast("double").alias("rate"))
    return spread.unionByName(own("total", "total")).unionByName(own("issuers", "issuers"))


@query(STATEMENTS, _SURVEYED, twin="SELECT ticker, period_end, metric, EXISTS (SELECT 1 FROM cr WHERE cr.ticker = fr.ticker AND cr.period_end = fr.period_end AND cr.metric = fr.metric AND abs(cr.value - fr.value) <= greatest(abs(cr.value), abs(fr.value), 1.0) * 0.02) AS similar FROM fr")
def segment_value_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed, second = _segment_rows(spark, sf_dir)
    return coverage.similar_values(filed, second, ["ticker", "period_end", "metric"], "value", 0.01).select("ticker", "period_end", "metric", "similar")


@query(STATEMENTS, _SURVEYED, "r AS (SELECT ticker, coalesce(source_poor_reason, 'none') AS reason, CASE WHEN parser_candidate THEN 'parse' WHEN source_poor_reason LIKE 'filing_cache%' THEN 'fetch' WHEN source_poor_reason IS NOT NULL THEN 'review' ELSE 'keep' END AS lane, fp + 10 * rp + ticker % 5 AS score FROM c4)",
    twin="SELECT lane, CAST(CASE lane WHEN 'parse' THEN 1 WHEN 'fetch' THEN 2 WHEN 'review' THEN 3 ELSE 9 END AS INTEGER) AS priority, nullif(reason, 'none') AS reason, count(*) AS n, round(avg(score), 6) AS mean_score, max(score) AS most, CAST(min(k) AS INTEGER) AS best_rank FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY score DESC, ticker) AS k FROM r) GROUP BY lane, reason")
def recovery_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.col("parser_candidate"), "parse", 1), (F.startswith("source_poor_reason", F.lit("filing_cache")), "fetch", 2), (F.col("source_poor_reason").isNotNull(), "review", 3)]
    scored = _survey(spark, sf_dir).withColumn("score", F.col("filing_periods") + 10 * F.col("filing_revenue_periods") + F.col("ticker") % 5)
    rows = coverage.recovery_rows(scored, "ticker", "score", reconcile.recovery(rules, ("keep", 9)))
    best = rows.groupBy("lane", F.col("source_poor_reason").alias("reason")).agg(F.min("priority_rank").alias("best_rank"))
    out = coverage.recovery_summary(rows).withColumn("mean_score", F.round("mean_score", 6)).alias("s")
    return out.join(best.alias("b"), (F.col("s.lane") == F.col("b.lane")) & F.col("s.reason").eqNullSafe(F.col("b.reason"))).select("s.*", "b.best_rank")


# incremental work


@query(_ORDERS, twin="SELECT ticker, date, k, value FROM od QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC, k DESC) = 1")
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files arrive, two loads from one checkpoint; the table holds the newest row of each key."""
    folder = shared.folder(spark, "upserts")
    rows = _orders(spark, sf_dir).select("ticker", "date", "k", "value").withColumn("at", F.struct("date", "k"))
    for name, part in (("a", "year(date) < 1996"), ("b", "year(date) BETWEEN 1996 AND 1997"), ("c", "year(date) > 1997")):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        streams.load(streams.source(spark, f"{folder}/in", rows.schema, 1), f"{folder}/state", streams.upsert_into(f"{folder}/out", ["ticker"], "at"))
    return streams.current(spark, f"{folder}/out").select("ticker", "date", "k", "value")


@query(FILINGS, twin=PANEL_TWIN)
def stream_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings arrive in three batches, restatements last; the panel that is kept up for the touched tickers equals the panel of all filings."""
    folder = shared.folder(spark, "revisions")
    kept = store.Store(spark, f"{folder}/store", {"filings": ["ticker"], "panel": ["ticker"]}, 8)
    keep = streams.maintain(kept, "filings", "filings", {"panel": lambda rows: st.revision_panel(rows, ["revenue", "net_income"])})
    rows = kept.staged(ad.filings(spark, sf_dir).select("ticker", "period_end", "available_date", "filing_date", "version", "revenue", "net_income"), "arriving")
    for part in ("version = 1", "version IN (2, 3)", "version > 3"):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        streams.load(streams.source(spark, f"{folder}/in", rows.schema), f"{folder}/state", keep)
    return kept.read("panel")


@query("ln AS (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem)", "y AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 24 MONTH)) AS DATE) AS f)", "w AS (SELECT f, least(CAST(f + INTERVAL 24 MONTH AS DATE) - 1, DATE '2001-12-31') AS t FROM y)",
    twin="SELECT f AS window_start, t AS window_end, 'completed' AS status, CAST(CASE WHEN f = DATE '1997-01-01' THEN 2 ELSE 1 END AS INTEGER) AS attempts, count(d) AS rows, count(d) AS stored FROM w LEFT JOIN ln ON d BETWEEN f AND t GROUP BY f, t")
def backfill_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in windows of two years; the second window fails when it is first loaded, and a second call runs it alone."""
    kept, down = store.Store(spark, shared.folder(spark, "backfill"), {"lines": ["date"], "ledger": ["job", "window_start"]}, 8), [True]
    rows = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"))

    def load(start: dt.date, end: dt.date) -> dict[str, DataFrame]:
        if start.year == 1997 and down:
            raise ConnectionError(down.pop())
        return {"lines": rows.where(F.col("date").between(F.lit(start), F.lit(end)))}

    for _ in range(2):
        ledger = store.backfill(kept, "lines", dt.date(1995, 1, 1), dt.date(2001, 12, 31), 24, load)
    days = kept.read("lines").groupBy("date").count()
    stored = ledger.join(days, F.col("date").between(F.col("window_start"), F.col("window_end")), "left").groupBy("window_start").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("stored"))
    return ledger.join(stored, "window_start").select("window_start", "window_end", "status", "attempts", "rows", "stored")


@query(_ORDERS, twin="SELECT k, status FROM od WHERE status IN ('O', 'P') AND ticker IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("report", F.when(F.col("status") == "F", "notice").otherwise("Annual REPORT"))
    universe = ad.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("ticker"))
    folder = shared.folder(spark, "changed")
    rows.write.parquet(f"{folder}/in")
    found = streams.changed_keys(streams.source(spark, f"{folder}/in", rows.schema), universe, "ticker", "report").select("k", "status")
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query(_ORDERS, twin="SELECT DISTINCT ticker FROM od WHERE ticker NOT IN (SELECT ticker FROM od WHERE status = 'F')")
def stale_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    marks = rows.select("ticker", F.when(F.col("status") == "F", F.current_date()).otherwise(F.date_sub(F.current_date(), 30)).alias("completed_at"))
    return streams.stale(rows.select("ticker").distinct(), marks, ["ticker"], 7)


@query(STATEMENTS, "o AS (SELECT ticker, list(revenue ORDER BY period_end) AS v, list(period_end ORDER BY period_end) AS d FROM stmts GROUP BY ticker)", twin="SELECT ticker, len(v) AS n, round(v[1], 4) AS first, round(v[len(v)], 4) AS last FROM o")
def smoothed_series_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ad.statements(spark, sf_dir).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("period_end", "revenue"))).alias("r"))
    v = own.select("ticker", st.smoothed_twice(F.col("r.revenue")).alias("v"))
    return v.select("ticker", F.size("v").cast("long").alias("n"), F.round(F.get("v", F.lit(0)), 4).alias("first"), F.round(F.try_element_at("v", F.lit(-1)), 4).alias("last"))


_PASS = "SELECT ticker, d, v, 1 AS i, [v[1]] AS o FROM {0} UNION ALL SELECT ticker, d, v, i + 1, list_append(o, CASE WHEN i + 1 < len(v) AND (o[i] + v[i + 2]) / 2 <> 0 AND NOT v[i + 1] / ((o[i] + v[i + 2]) / 2) BETWEEN 0.5 AND 2 THEN (o[i] + v[i + 2]) / 2 ELSE v[i + 1] END) FROM {1} WHERE i < len(v)"


@query("RECURSIVE " + STATEMENTS, "s0 AS (SELECT ticker, list(period_end ORDER BY period_end) AS d, list(CASE WHEN fiscal_quarter = 2 THEN revenue * 4 ELSE revenue END ORDER BY period_end) AS v FROM stmts GROUP BY ticker)", f"s1 AS ({_PASS.format('s0', 's1')})", "s2 AS (SELECT ticker, d, o AS v FROM s1 WHERE i = len(v))", f"s3 AS ({_PASS.format('s2', 's3')})",
    twin="SELECT ticker, unnest(d) AS period_end, round(unnest(o), 4) AS revenue FROM s3 WHERE i = len(v)")
def smoothed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("fiscal_quarter") == 2, F.col("revenue") * 4).otherwise(F.col("revenue")).alias("v")
    own = ad.statements(spark, sf_dir).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("period_end", value))).alias("r"))
    rows = own.select("ticker", F.explode(F.arrays_zip(F.col("r.period_end").alias("period_end"), st.smoothed_twice(F.col("r.v")).alias("revenue"))).alias("o"))
    return rows.select("ticker", "o.period_end", F.round("o.revenue", 4).alias("revenue"))
