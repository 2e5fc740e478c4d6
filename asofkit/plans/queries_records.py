"""Queries over facts, intervals, sources and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as col
from ..functions import windows as win
from ..operators import dedupe, intervals, quality, reconcile, rules
from ..operators import statements as st
from ..sources import adapters as ad
from ..sources import io, shared
from ..streaming import streams
from .registry import BARS, EVENTS, FILINGS, STATEMENTS, query

_FACTS = "facts AS (SELECT ticker, period_end, fiscal_year, fiscal_quarter, metric, value FROM stmts UNPIVOT (value FOR metric IN (revenue, cogs, net_income)))"
_INTERVALS = "iv AS (SELECT ticker, date AS valid_from, nxt - 1 AS valid_to FROM (SELECT *, lead(date) OVER (PARTITION BY ticker ORDER BY date, CASE action WHEN 'remove' THEN 0 ELSE 1 END, event_id) AS nxt FROM events_m) WHERE action = 'add' AND (nxt IS NULL OR nxt - 1 >= date))"


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.events_to_intervals(ad.membership_events(spark, sf_dir), ["ticker"])


def _day(text: str):
    return F.lit(text).cast("date")


@query(EVENTS, _INTERVALS, twin="SELECT * FROM iv")
def events_to_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir)


@query(EVENTS, twin="""SELECT ticker, event_id, issue FROM (SELECT *, CASE WHEN action = 'remove' AND coalesce(prev = 'remove', TRUE) THEN 'remove_without_add' WHEN action = 'add' AND nxt - 1 < date THEN 'reversed' END AS issue FROM (
 SELECT *, lag(action) OVER w AS prev, lead(date) OVER w AS nxt FROM events_m WINDOW w AS (PARTITION BY ticker ORDER BY date, CASE action WHEN 'remove' THEN 0 ELSE 1 END, event_id))) WHERE issue IS NOT NULL""")
def event_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.event_issues(ad.membership_events(spark, sf_dir), ["ticker"]).select("ticker", "event_id", "issue")


@query(EVENTS, _INTERVALS, twin="SELECT ticker, valid_from, valid_to FROM iv WHERE valid_from <= DATE '1998-06-30' AND coalesce(valid_to, DATE '9999-12-31') >= DATE '1998-06-30' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY valid_from DESC, valid_to) = 1")
def interval_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.interval_asof(_intervals(spark, sf_dir), ["ticker"], _day("1998-06-30"), [F.col("valid_to").asc_nulls_last()])


@query(EVENTS, _INTERVALS, twin="""SELECT ticker, CASE WHEN b THEN 'added' ELSE 'removed' END AS change FROM (SELECT ticker, bool_or(valid_from <= DATE '1997-01-01' AND coalesce(valid_to, DATE '9999-12-31') >= DATE '1997-01-01') AS a,
 bool_or(valid_from <= DATE '1999-01-01' AND coalesce(valid_to, DATE '9999-12-31') >= DATE '1999-01-01') AS b FROM iv GROUP BY ticker) WHERE a <> b""")
def membership_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.membership_diff(_intervals(spark, sf_dir), "ticker", _day("1997-01-01"), _day("1999-01-01"))


@query(EVENTS, _INTERVALS, twin="""SELECT d.date, (SELECT count(DISTINCT ticker) FROM iv WHERE valid_from <= d.date AND coalesce(valid_to, DATE '9999-12-31') >= d.date) AS n
 FROM (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS date) d WHERE dayofweek(d.date) BETWEEN 1 AND 5""")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.daily_counts(_intervals(spark, sf_dir), ["ticker"], _day("1996-01-01"), _day("1998-12-31"))


_SPANS = "sp AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS valid_from, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INTEGER) END AS valid_to, o_orderkey AS id, o_orderpriority AS label FROM orders)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderstatus") != "P", F.date_add(start, F.pmod("o_orderkey", F.lit(200)).cast("int")))
    return ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), start.alias("valid_from"), end.alias("valid_to"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))


@query(_SPANS, twin="SELECT ticker, id FROM (SELECT *, max(coalesce(valid_to, DATE '9999-12-31')) OVER (PARTITION BY ticker ORDER BY valid_from, coalesce(valid_to, DATE '9999-12-31'), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp) WHERE valid_from <= reach")
def overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    w = Window.partitionBy("ticker").orderBy("valid_from", F.coalesce("valid_to", _day("9999-12-31")), "id").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.withColumn("reach", F.max(F.coalesce("valid_to", _day("9999-12-31"))).over(w))
    return reach.where("valid_from <= reach").select("ticker", "id")


@query(EVENTS, _INTERVALS, _SPANS, twin="""SELECT a.ticker, b.id, greatest(a.valid_from, b.valid_from) AS valid_from, nullif(least(coalesce(a.valid_to, DATE '9999-12-31'), coalesce(b.valid_to, DATE '9999-12-31')), DATE '9999-12-31') AS valid_to
 FROM iv a JOIN sp b ON a.ticker = b.ticker AND coalesce(a.valid_to, DATE '9999-12-31') >= b.valid_from AND a.valid_from <= coalesce(b.valid_to, DATE '9999-12-31')""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_join(_intervals(spark, sf_dir), _spans(spark, sf_dir), ["ticker"], [], ["id"])


@query(_SPANS, twin="""SELECT o_orderkey AS row_id, o_custkey AS ticker, day, s.label FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) + 30 AS day FROM orders) r LEFT JOIN sp s ON s.ticker = r.o_custkey AND r.day >= s.valid_from AND r.day <= coalesce(s.valid_to, DATE '9999-12-31')
 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY s.valid_from DESC NULLS LAST, s.id) = 1""")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("ticker"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("day"))
    return intervals.point_in_interval(rows, _spans(spark, sf_dir), ["ticker"], "day", ["label"], [F.col("id")])


@query(_SPANS, """base AS (SELECT DISTINCT ticker, DATE '1995-01-01' AS f, DATE '2001-12-31' AS t, 'base' AS v FROM sp)""", """ov AS (SELECT ticker, valid_from AS f, valid_to AS t, label AS v FROM sp WHERE id % 7 = 0 AND valid_to IS NOT NULL)""",
    "day AS (SELECT ticker, CAST(unnest(generate_series(f, t, INTERVAL 1 DAY)) AS DATE) AS d, v FROM base)", """pick AS (SELECT d.ticker, d.d, coalesce((SELECT o.v FROM ov o WHERE o.ticker = d.ticker AND o.f <= d.d AND o.t >= d.d ORDER BY o.f DESC, o.v LIMIT 1), CASE WHEN d.d <= DATE '2001-12-31' THEN d.v END) AS v FROM (
  SELECT ticker, d, v FROM day UNION SELECT ticker, CAST(unnest(generate_series(DATE '2002-01-01', t, INTERVAL 1 DAY)) AS DATE), NULL FROM ov WHERE t > DATE '2001-12-31') d)""",
    "isl AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY ticker, v ORDER BY d) AS INTEGER) AS g FROM pick)", twin="SELECT ticker, v AS label, min(d) AS valid_from, max(d) AS valid_to FROM isl GROUP BY ticker, v, g")
def interval_override_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    base = spans.select("ticker").distinct().select("ticker", _day("1995-01-01").alias("valid_from"), _day("2001-12-31").alias("valid_to"), F.lit("base").alias("label"))
    overrides = spans.where("id % 7 = 0 AND valid_to IS NOT NULL").select("ticker", "valid_from", "valid_to", "label")
    return intervals.with_overrides(base, overrides, ["ticker"], "label")


@query("snap AS (SELECT DISTINCT o_custkey AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM orders)", "d AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT day FROM snap))",
    twin="""SELECT s.ticker, s.day AS date, 'add' AS action FROM snap s JOIN d USING (day) WHERE prev IS NULL OR NOT EXISTS (SELECT 1 FROM snap p WHERE p.ticker = s.ticker AND p.day = d.prev)
 UNION ALL SELECT s.ticker, d.nxt, 'remove' FROM snap s JOIN d USING (day) WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snap p WHERE p.ticker = s.ticker AND p.day = d.nxt)""")
def snapshot_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.trunc("o_orderdate", "month").alias("day"))
    return intervals.snapshots_to_events(snaps, "ticker", "day")


_YTD = "ytd AS (SELECT ticker, period_end, fiscal_year, fiscal_quarter, sum(revenue) OVER (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter) AS ytd FROM stmts)"


@query(STATEMENTS, _YTD, twin="SELECT ticker, period_end, CASE WHEN fiscal_quarter = 1 THEN ytd ELSE ytd - lag(ytd) OVER (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter) END AS revenue FROM ytd")
def decumulate_ytd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.year_to_date(spark, sf_dir)
    return rows.select("ticker", "period_end", st.decumulate(rows, "ytd").alias("revenue"))


@query(STATEMENTS, "yt AS (SELECT ticker, period_end, fiscal_year, fiscal_quarter, CASE WHEN ticker % 2 = 0 THEN sum(revenue) OVER (PARTITION BY ticker, fiscal_year ORDER BY fiscal_quarter) ELSE revenue END AS x FROM stmts)",
    "yr AS (SELECT ticker, fiscal_year, max(CASE WHEN fiscal_quarter = 1 THEN x END) AS q1, max(CASE WHEN fiscal_quarter = 2 THEN x END) AS q2, max(CASE WHEN fiscal_quarter = 3 THEN x END) AS q3, max(CASE WHEN fiscal_quarter = 4 THEN x END) AS q4 FROM yt GROUP BY 1, 2)",
    "vote AS (SELECT ticker, avg(CAST(q2 > 1.3 * q1 AS INTEGER)) > 0.5 AS cum, avg(CAST(q4 < 0.6 * (q1 + q2 + q3) AS INTEGER)) > 0.5 AS alone FROM yr GROUP BY 1)",
    twin="SELECT y.ticker, period_end, CASE WHEN fiscal_quarter = 1 OR NOT coalesce(cum, FALSE) THEN x WHEN fiscal_quarter = 4 AND alone THEN x ELSE x - lag(x) OVER (PARTITION BY y.ticker, fiscal_year ORDER BY fiscal_quarter) END AS revenue FROM yt y JOIN vote v ON v.ticker = y.ticker")
def decumulate_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.by("ticker", "fiscal_year", order="fiscal_quarter")
    rows = ad.statements(spark, sf_dir).withColumn("x", F.when(F.col("ticker") % 2 == 0, F.sum("revenue").over(w)).otherwise(F.col("revenue")))
    return st.decumulate_voted(rows.select("ticker", "period_end", "fiscal_year", "fiscal_quarter", "x"), "x", "revenue").select("ticker", "period_end", "revenue")


@query(STATEMENTS, "fy AS (SELECT *, sum(revenue) OVER (PARTITION BY ticker, fiscal_year) AS total, CASE WHEN fiscal_quarter = 4 THEN NULL ELSE revenue END AS q FROM stmts)",
    twin="""SELECT ticker, period_end, CASE WHEN fiscal_quarter = 4 AND date_diff('day', lag(period_end, 1) OVER w, period_end) BETWEEN 70 AND 130 AND date_diff('day', lag(period_end, 2) OVER w, lag(period_end, 1) OVER w) BETWEEN 70 AND 130 AND date_diff('day', lag(period_end, 3) OVER w, lag(period_end, 2) OVER w) BETWEEN 70 AND 130
 THEN total - (lag(q, 1) OVER w + lag(q, 2) OVER w + lag(q, 3) OVER w) ELSE q END AS revenue FROM fy WINDOW w AS (PARTITION BY ticker ORDER BY period_end)""")
def q4_from_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir).withColumns({"total": F.sum("revenue").over(Window.partitionBy("ticker", "fiscal_year")), "q": F.when(F.col("fiscal_quarter") != 4, F.col("revenue"))})
    return st.fill_fourth_quarter(rows, "total", "q", "filled").select("ticker", "period_end", F.col("filled").alias("revenue"))


@query(STATEMENTS, _FACTS, twin="SELECT ticker, period_end, max(CASE WHEN metric = 'revenue' THEN value END) AS revenue, max(CASE WHEN metric = 'cogs' THEN value END) AS cogs, max(CASE WHEN metric = 'net_income' THEN value END) AS net_income FROM facts GROUP BY 1, 2")
def pivot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.wide(ad.facts(spark, sf_dir, "revenue", "cogs", "net_income"), ["ticker", "period_end"], ["revenue", "cogs", "net_income"], ["period_end"])


@query(STATEMENTS, _FACTS, twin="SELECT * FROM facts")
def unpivot_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.facts(spark, sf_dir, "revenue", "cogs", "net_income")


@query(STATEMENTS, _FACTS, twin="SELECT ticker, fiscal_year, sum(CASE WHEN metric = 'revenue' THEN value END) AS revenue, sum(CASE WHEN metric LIKE 'c%' THEN value END) AS costs FROM facts GROUP BY 1, 2")
def conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.conditional_sums(ad.facts(spark, sf_dir, "revenue", "cogs", "net_income"), ["ticker", "fiscal_year"], {"revenue": F.col("metric") == "revenue", "costs": F.col("metric").startswith("c")})


@query(FILINGS, twin="SELECT ticker, period_end, version, opex FROM filings QUALIFY row_number() OVER (PARTITION BY ticker, period_end ORDER BY CAST(opex IS NOT NULL AS INTEGER) + CAST(revenue IS NOT NULL AS INTEGER) DESC, filing_date, version) = 1")
def best_row_by_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.most_complete(ad.filings(spark, sf_dir), ["ticker", "period_end"], ["opex", "revenue"], ["filing_date", "version"]).select("ticker", "period_end", "version", "opex")


#: priority, code, low, high, keywords, label
_RULES = [(1, 7, None, None, "", "seven"), (2, None, 10, 15, "", "ten_to_fifteen"), (3, None, None, None, "ring|bolt", "hardware"), (4, None, 30, 40, "", "large")]


@query(twin="""SELECT p_partkey, CASE WHEN p_size = 7 THEN 'seven' WHEN p_size BETWEEN 10 AND 15 THEN 'ten_to_fifteen' WHEN lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%' THEN 'hardware' WHEN p_size BETWEEN 30 AND 40 THEN 'large' ELSE 'other' END AS label FROM part""")
def rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = spark.createDataFrame(_RULES, "priority int, code int, low int, high int, keywords string, label string")
    return rules.lookup(ad.table(spark, sf_dir, "part"), ordered, "p_size", "p_name", "other").select("p_partkey", "label")


_OTHER = """src2 AS (SELECT ticker, period_end, fiscal_year, fiscal_quarter, metric, CASE WHEN k = 50 THEN -value WHEN k % 10 = 3 THEN value * 1.1 ELSE value END AS value FROM (
  SELECT *, (ticker * 31 + fiscal_year * 7 + fiscal_quarter * 3 + length(metric)) % 100 AS k FROM facts) WHERE k % 20 <> 7)"""
_COMPARED = """cmp AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.period_end, b.period_end) AS period_end, coalesce(a.metric, b.metric) AS metric, a.value, b.value AS value_r,
  CASE WHEN a.value <> 0 THEN abs(a.value - b.value) / abs(a.value) WHEN b.value = 0 THEN 0 END AS pct, coalesce(CASE WHEN a.value <> 0 THEN abs(a.value - b.value) / abs(a.value) WHEN b.value = 0 THEN 0 END > 0.02, a.value <> b.value, FALSE) AS breached, coalesce(sign(a.value) * sign(b.value) < 0, FALSE) AS sign_mismatch
  FROM facts a FULL JOIN src2 b ON a.ticker = b.ticker AND a.period_end = b.period_end AND a.metric = b.metric)"""
_STATUS = "CASE WHEN value IS NULL AND value_r IS NULL THEN 'missing_both' WHEN value IS NULL THEN 'missing_left' WHEN value_r IS NULL THEN 'missing_right' WHEN breached THEN 'breach' ELSE 'match' END"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = ("revenue", "cogs", "net_income")
    policy = spark.createDataFrame([(m, "relative", 0.02, "as_is", 1.0) for m in metrics], "metric string, kind string, tolerance double, sign_rule string, scale double")
    return reconcile.compare_sources(ad.both_sources(spark, sf_dir, *metrics), ["ticker", "period_end"], "source", ("first", "second"), policy)


@query(STATEMENTS, _FACTS, _OTHER, _COMPARED, twin=f"SELECT ticker, period_end, metric, value, round(value_r, 3) AS value_r, round(pct, 6) AS pct_diff, sign_mismatch, {_STATUS} AS status FROM cmp")
def reconcile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("ticker", "period_end", "metric", "value", F.round("value_r", 3).alias("value_r"), F.round("pct_diff", 6).alias("pct_diff"), "sign_mismatch", "status")


@query(STATEMENTS, _FACTS, _OTHER, _COMPARED, twin=f"SELECT metric, count(*) AS n, CAST(count_if(breached) AS BIGINT) AS breaches, CAST(count_if({_STATUS} = 'missing_left') AS BIGINT) AS missing_left, CAST(count_if({_STATUS} = 'missing_right') AS BIGINT) AS missing_right, CAST(count_if(sign_mismatch) AS BIGINT) AS sign_mismatches, round(avg(pct), 6) AS mean_pct, round(max(abs(value - value_r)), 3) AS max_abs FROM cmp GROUP BY metric")
def reconcile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.report(_compared(spark, sf_dir), "metric").withColumns({"mean_pct": F.round("mean_pct", 6), "max_abs": F.round("max_abs", 3)})


@query(STATEMENTS, "a AS (SELECT ticker, period_end, row_number() OVER (PARTITION BY ticker ORDER BY period_end) AS n FROM stmts)", "b AS (SELECT ticker, CAST(period_end + 40 AS DATE) AS d, row_number() OVER (PARTITION BY ticker ORDER BY period_end) AS n FROM stmts WHERE NOT (ticker % 3 = 0 AND period_end < DATE '1995-06-01'))",
    "p AS (SELECT a.ticker, o.off, count(*) AS pairs, max(abs(date_diff('day', a.period_end, b.d))) AS dmax FROM a, (SELECT unnest([0, 1, -1]) AS off) o, b WHERE b.ticker = a.ticker AND b.n = a.n + o.off GROUP BY 1, 2)",
    twin="SELECT ticker, off AS \"offset\", pairs FROM p WHERE pairs >= 3 AND dmax <= 60 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pairs DESC, CASE off WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) = 1")
def sequence_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ad.statements(spark, sf_dir).select("ticker", "period_end")
    right = left.where("NOT (ticker % 3 = 0 AND period_end < DATE '1995-06-01')").select("ticker", F.date_add("period_end", 40).alias("period_end"))
    return reconcile.sequence_aligned(left, right, "ticker", "period_end", 60)


_BOTH = "bth AS (SELECT *, 'first' AS source FROM facts UNION ALL SELECT *, 'second' FROM src2)"


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = ("revenue", "cogs", "net_income")
    return ad.both_sources(spark, sf_dir, *metrics)


@query(STATEMENTS, _FACTS, _OTHER, _BOTH, twin="SELECT ticker, period_end, metric, count(DISTINCT source) AS sources, count(value) AS n, max(value) - min(value) <= 0.05 * greatest(max(abs(value)), 1.0) AS agree FROM bth GROUP BY 1, 2, 3")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.consensus(_both(spark, sf_dir), ["ticker", "period_end", "metric"], "source", "value")


@query(STATEMENTS, _FACTS, _OTHER, _BOTH, twin="""SELECT ticker, CAST(count_if(source = 'first') AS BIGINT) AS rows_first, CAST(count_if(source = 'second') AS BIGINT) AS rows_second, count(DISTINCT CASE WHEN source = 'first' THEN period_end END) AS periods_first, count(DISTINCT CASE WHEN source = 'second' THEN period_end END) AS periods_second,
 (SELECT count(*) FROM (SELECT DISTINCT period_end FROM facts f WHERE f.ticker = t.ticker INTERSECT SELECT DISTINCT period_end FROM src2 s WHERE s.ticker = t.ticker)) AS overlap, 'overlap' AS cluster FROM bth t GROUP BY ticker""")
def coverage_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.clusters(reconcile.coverage(_both(spark, sf_dir), "ticker", "period_end", "source", ["first", "second"]), "first", "second")


@query(STATEMENTS, twin="SELECT ticker, count(*) AS n, min(period_end) AS first, max(period_end) AS last, round(avg(CAST(opex IS NULL AS INTEGER)), 6) AS null_opex FROM stmts GROUP BY ticker")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(ad.statements(spark, sf_dir), ["ticker"], "period_end", ["opex"]).withColumn("null_opex", F.round("null_opex", 6))


@query(STATEMENTS, twin="SELECT c AS \"column\", total, p AS present, total - p AS missing, round(1 - p / total, 6) AS rate FROM (SELECT count(*) AS total, count(opex) AS opex, count(revenue) AS revenue FROM stmts) UNPIVOT (p FOR c IN (opex, revenue))")
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_rates(ad.statements(spark, sf_dir), ["opex", "revenue"]).withColumn("rate", F.round("rate", 6))


@query(twin="SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rows(ad.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_AVAILABLE = "av AS (SELECT ticker, CASE WHEN ticker % 3 = 0 THEN NULL ELSE filing_date END AS filed, period_end, form FROM stmts)"


@query(STATEMENTS, _AVAILABLE, twin="""SELECT ticker, period_end, coalesce(filed, period_end + CASE WHEN form = '10-K' THEN 90 ELSE 45 END) AS available_date, CASE WHEN filed IS NOT NULL THEN 'filed' WHEN form = '10-K' THEN 'fallback_90' ELSE 'fallback_45' END AS method FROM av""")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.statements(spark, sf_dir).withColumn("filed", F.when(F.col("ticker") % 3 != 0, F.col("filing_date"))).withColumn("accepted", F.lit(None).cast("timestamp"))
    return rows.select("ticker", "period_end", *(c.alias(n) for n, c in col.availability("accepted", "filed", "period_end", "form").items()))


@query(STATEMENTS, _AVAILABLE, twin="SELECT fiscal_year, count(*) AS n, CAST(1 AS DOUBLE) AS available, round(avg(CAST(ticker % 3 = 0 AS INTEGER)), 6) AS fallback, CAST(0 AS DOUBLE) AS accepted FROM stmts GROUP BY fiscal_year")
def fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = availability(spark, sf_dir).withColumn("fiscal_year", F.year("period_end"))
    return quality.fill_rates(rows, ["fiscal_year"]).withColumn("fallback", F.round("fallback", 6))


@query(STATEMENTS, twin="SELECT ticker, 0 AS missing, 0 AS duplicates FROM stmts GROUP BY ticker HAVING max(fiscal_year * 4 + fiscal_quarter) - min(fiscal_year * 4 + fiscal_quarter) = count(*) - 1 UNION ALL SELECT ticker, max(fiscal_year * 4 + fiscal_quarter) - min(fiscal_year * 4 + fiscal_quarter) - count(*) + 1, 0 FROM stmts GROUP BY ticker HAVING max(fiscal_year * 4 + fiscal_quarter) - min(fiscal_year * 4 + fiscal_quarter) <> count(*) - 1")
def fiscal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.fiscal_gaps(ad.statements(spark, sf_dir))


_OLD = "old_o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "new_o AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return rows.where("k % 3 <> 0"), rows.where("k % 2 = 0 OR k % 3 = 0").withColumn("v", F.col("v") * 2)


@query(_OLD, _NEW, twin="SELECT * FROM old_o WHERE k NOT IN (SELECT k FROM new_o) UNION ALL SELECT * FROM new_o")
def upsert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.upsert(*_old_new(spark, sf_dir), ["k"])


@query(_OLD, _NEW, twin="SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v FROM old_o o FULL JOIN new_o n ON o.k = n.k")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.merge(*_old_new(spark, sf_dir), ["k"])


@query(_OLD, _NEW, twin="SELECT k, v FROM (SELECT *, 0 AS b FROM old_o UNION ALL SELECT *, 1 FROM new_o) QUALIFY row_number() OVER (PARTITION BY k ORDER BY b DESC) = 1")
def append_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.append_newest(*_old_new(spark, sf_dir), ["k"])


@query(_SPANS, EVENTS, _INTERVALS, twin="""SELECT id, CASE WHEN min(i.valid_from) IS NOT NULL THEN min(greatest(date_diff('day', s.valid_from, i.valid_from), date_diff('day', coalesce(i.valid_to, DATE '9999-12-31'), s.valid_from), 0)) END AS days, CAST(coalesce(count_if(i.valid_from <= s.valid_from AND coalesce(i.valid_to, DATE '9999-12-31') >= s.valid_from), 0) AS BIGINT) AS covering,
 CASE WHEN min(i.valid_from) IS NULL THEN 'missing' WHEN min(greatest(date_diff('day', s.valid_from, i.valid_from), date_diff('day', coalesce(i.valid_to, DATE '9999-12-31'), s.valid_from), 0)) <= 5 THEN 'pass' WHEN min(greatest(date_diff('day', s.valid_from, i.valid_from), date_diff('day', coalesce(i.valid_to, DATE '9999-12-31'), s.valid_from), 0)) <= 60 THEN 'warn' ELSE 'fail' END AS status
 FROM sp s LEFT JOIN iv i ON i.ticker = s.ticker GROUP BY id""")
def trade_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = _spans(spark, sf_dir).select("ticker", "id", F.col("valid_from").alias("date"))
    out = quality.outside_validity(trades, _intervals(spark, sf_dir), "ticker", "date", "id", 5, 60)
    return out.select("id", F.when(F.col("status") != "missing", F.col("days")).alias("days"), "covering", "status")


# streams: each runs all there is and returns the final state, which the batch twin must equal


def _streamed(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A stream over the events table, written as Parquet in a folder that the cluster shares, read back."""
    table = ad.table(spark, sf_dir, "events")
    folder = shared.folder(spark, "stream")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events*").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = build(stream)
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(twin="SELECT DISTINCT ON (event_id) event_id, user_id, event_type FROM events ORDER BY event_id")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda e: streams.deduplicated(e.unionByName(e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES")))).select("event_id", "user_id", "event_type"))


@query(twin="SELECT window_start, event_type, n, round(total, 4) AS total FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = ad.table(spark, sf_dir, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 1 HOUR")).alias("mark"))
    done = _streamed(spark, sf_dir, lambda e: streams.windowed(e, "6 hours"))
    return done.join(F.broadcast(last), F.col("window_end") <= F.col("mark")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS brk FROM events)", "s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)",
    twin="SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = ad.table(spark, sf_dir, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 1 HOUR")).alias("mark"))
    done = _streamed(spark, sf_dir, lambda e: streams.sessions(e, "2 hours"))
    return done.join(F.broadcast(last), F.col("session_end") <= F.col("mark")).select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n", F.round("total", 4).alias("total"))


@query(twin="SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS digit, count(*) AS n FROM events GROUP BY 1, 2")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return ad.table(spark, sf_dir, "events").groupBy("event_type", (k % 10).alias("digit")).agg(F.count("*").alias("n"))
