"""Whole jobs as one call: facts to statements, canonical tables, valuation bands, statement views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as win
from ..functions.columns import availability, filled_totals, mapped, multiple, null_sum
from ..operators import asof, dedupe, facts, intervals, quality, reconcile
from ..operators import statements as st


def facts_to_quarters(raw: DataFrame, flows: Mapping[str, str], stocks: Mapping[str, str], key: str = "ticker") -> DataFrame:
    """Raw facts (ticker, concept, period_start, period_end, value, form, filed) to one row per quarter with availability.

    flows and stocks map concepts to columns. Flows follow all rules of quarters_from_facts(), stocks are the first filed instant.
    """
    named = lambda m: F.create_map(*(F.lit(x) for p in m.items() for x in p))
    rows = raw.withColumn("metric", F.coalesce(F.try_element_at(named(flows), F.col("concept")), F.try_element_at(named(stocks), F.col("concept")))).where("metric IS NOT NULL")
    own = facts.quarters_from_facts(rows.where(F.col("metric").isin(*flows.values())), [key, "metric"]).select(key, "metric", "period_end", "value")
    held = facts.balance_facts(rows.where(F.col("metric").isin(*stocks.values())), [key, "metric"], ["filed", "value"]).select(key, "metric", "period_end", "value")
    wide = st.wide(own.unionByName(held), [key, "period_end"], [*flows.values(), *stocks.values()], ["period_end"])
    filed = raw.groupBy(key, "period_end").agg(F.min("filed").alias("filed"), F.min_by("form", "filed").alias("form"))
    dated = wide.join(filed, [key, "period_end"], "left").withColumn("__accepted", F.lit(None).cast("timestamp"))
    return dated.withColumns({n: c for n, c in availability("__accepted", "filed", "period_end", "form").items()}).drop("__accepted")


def accounts_to_quarters(rows: DataFrame, ids: DataFrame, names: DataFrame, patterns: DataFrame, metrics: Sequence[str], key: str = "ticker") -> DataFrame:
    """Raw accounts (account_id, account_name, fiscal_year, fiscal_quarter, ord, value) to (ticker, fiscal_year, metric, q1..q4, mode)."""
    mapped = facts.canonical_accounts(rows, ids, names, patterns).where(F.col("metric").isin(*metrics)).withColumn("__no", F.lit(False))
    picked = dedupe.by_priority(mapped, [key, "metric", "fiscal_year", "fiscal_quarter"], ["match_priority"], "ord", "value", "__no")
    keyed = picked.withColumn("__key", F.struct(key, "metric"))
    out = facts.two_hypotheses(keyed.drop(key, "metric").withColumnRenamed("__key", key), "value", key)
    return out.select(F.col(f"{key}.{key}").alias(key), F.col(f"{key}.metric").alias("metric"), "fiscal_year", "q1", "q2", "q3", "q4", "mode")


def canonical_tables(links: DataFrame, names: DataFrame, daily: DataFrame) -> dict[str, DataFrame]:
    """links (entity, security, primary) and names (security, name) as intervals: the history where both hold, the entity's last row, and daily rows with their entity."""
    history = intervals.overlap_join(links, names, ["security"], ["entity", "primary"], ["name"])
    latest = dedupe.first_per_key(history, ["entity"], [F.col("valid_from").desc(), "security"]).drop("valid_to")
    stats = history.groupBy("entity").agg(F.count_distinct("security").alias("n_securities"))
    return {
        "history": history,
        "entities": latest.join(stats, "entity"),
        "daily": intervals.point_in_interval(daily, links, ["security"], "date", ["entity"], [F.col("entity")]),
    }


def valuation_payload(statements: DataFrame, prices: DataFrame, years: Sequence[int] = (5, 10), points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(window, ticker, period_end, eps, band_1..): trailing earnings per share times the quantiles of their multiples over the last years, and over all."""
    w = win.by("ticker", order="period_end")
    rows = statements.withColumn("eps", win.ttm("net_income", w) / F.nullif(F.col("shares"), F.lit(0.0))).where("eps IS NOT NULL").select("ticker", "period_end", "eps")
    priced = asof.at_period_end(rows, prices, ["ticker"], "period_end", "date", ["adj_close", "close"], "price").withColumn("per", multiple("price", "eps"))
    number = F.row_number().over(win.by("ticker", order=[F.col("period_end").desc()]))
    lasts = F.array_compact(F.array(*(F.when(F.col("__n") <= 4 * n, F.lit(f"{n}y")) for n in years), F.lit("all")))
    rows = priced.withColumn("__n", number).select("ticker", "period_end", "eps", "per", F.explode(lasts).alias("window"))
    return facts.own_price_bands(rows, "per", ["ticker", "window"], points=points)


def statement_view(statements: DataFrame, metrics: Sequence[str], ratios: Mapping[str, Column], basis: str = "quarter", years: int = 5, flows: Sequence[str] = ()) -> DataFrame:
    """Long rows (ticker, period_end, metric, value, yoy) of a statement on a basis (quarter, ttm or annual) over the last years."""
    w = win.by("ticker", order="period_end")
    stocks = [m for m in metrics if m not in flows]
    if basis == "annual":
        rows, k, per_year = st.annual_fiscal(statements, list(flows), stocks), 1, 1
    else:
        rows, k, per_year = (statements.withColumns({m: win.ttm(m, w, "partial") for m in flows}) if basis == "ttm" else statements), 4, 4
    rows = rows.select("ticker", "period_end", *metrics).withColumns(dict(ratios))
    names = [*metrics, *ratios]
    long = rows.unpivot(["ticker", "period_end"], names, "metric", "value")
    grown = long.withColumn("yoy", win.growth("value", win.by("ticker", "metric", order="period_end"), k))
    kept = st.last_years(rows.select("ticker", "period_end"), years, per_year)
    return grown.join(kept, ["ticker", "period_end"], "left_semi")


def kpi_rows(statements: DataFrame, metrics: Sequence[str], n: int = 5) -> DataFrame:
    """The last n periods of some metrics with their yearly growth."""
    return statement_view(statements, metrics, {}, "quarter", 10_000).join(st.last_years(statements.select("ticker", "period_end"), n, 1), ["ticker", "period_end"], "left_semi")


def base_frame(statements: DataFrame, names: Mapping[str, Sequence[str]], prices: DataFrame | None = None) -> DataFrame:
    """Canonical columns from the first candidate that a row has, and what follows from them.

    names maps revenue, cogs, gross, operating_income, pretax, tax, net_income, cfo, capex, short_debt, long_debt, other_1, other_2 to candidates. Adds filled totals,
    non_operating (pretax - operating income, else the sum of its parts), fcf = cfo - |capex|, debt (a missing part is 0) and, with prices, the last close.
    """
    rows = statements.select("ticker", "period_end", *(F.coalesce(*(F.col(c) for c in cs if c in statements.columns), F.lit(None).cast("double")).alias(n) for n, cs in names.items()))
    rows = rows.withColumns(filled_totals("revenue", "cogs", "gross", "pretax", "tax", "net_income")).withColumn("gross", F.coalesce("gross", F.col("revenue") - F.col("cogs")))
    rows = rows.withColumns({
        "non_operating": F.coalesce(F.col("pretax") - F.col("operating_income"), null_sum("other_1", "other_2")),
        "fcf": F.col("cfo") - F.abs("capex"),
        "debt": F.coalesce("short_debt", F.lit(0.0)) + F.coalesce("long_debt", F.lit(0.0)),
    })
    return rows if prices is None else asof.at_period_end(rows, prices, ["ticker"], "period_end", "date", ["adj_close", "close"], "price")


def segment_reconciliation(rows: DataFrame, sources: Sequence[str], keys: Sequence[str] = ("ticker", "segment"), period: str = "period_end", source: str = "source", value: str = "value", rank: str = "rank") -> DataFrame:
    """Per segment: its best rows by source collapsed, both sources' coverage, agreement over the periods that both have, the cluster and the status."""
    best = dedupe.first_per_key(rows, [*keys, period, source], [rank, F.col(value).desc()])
    covered = reconcile.clusters(reconcile.coverage(best.withColumn("__k", F.struct(*keys)), "__k", period, source, list(sources)), *sources)
    agreed = reconcile.consensus(best, [*keys, period], source, value).where("sources > 1").groupBy(*keys).agg(F.count("*").alias("compared"), F.count_if("agree").alias("agreeing"))
    steady = quality.temporal_consistency(best, keys, period, source)
    out = covered.select(*(F.col(f"__k.{k}").alias(k) for k in keys), *(f"rows_{s}" for s in sources), "overlap", "cluster").join(steady, list(keys)).join(agreed, list(keys), "left").fillna(0, ["compared", "agreeing"])
    return out.withColumn("status", F.when(F.col("compared") == 0, "not_compared").when(F.col("agreeing") == F.col("compared"), "match").otherwise("breach"))


def second_market_tables(master: DataFrame, reported: DataFrame, tiers: Mapping[str, str], currency: str) -> dict[str, DataFrame]:
    """master (isin, name, tier) with its code from the ISIN, and reported totals (isin, fiscal_year, fiscal_quarter, currency, ytd, quarter) as quarters and years.

    A quarter is the total less the one before, or as reported where that lacks; rows in other currencies go.
    """
    code = F.substring("isin", 4, 6)
    companies = master.select(code.alias("ticker"), "name", mapped("tier", tiers, "other").alias("tier"))
    rows = reported.where(F.col("currency") == currency).select(code.alias("ticker"), "fiscal_year", "fiscal_quarter", "ytd", "quarter")
    quarterly = rows.withColumn("value", F.coalesce(st.decumulate(rows, "ytd"), "quarter")).select("ticker", "fiscal_year", "fiscal_quarter", "value")
    annual = rows.where("fiscal_quarter = 4 AND ytd IS NOT NULL").select("ticker", "fiscal_year", F.col("ytd").alias("value"))
    return {"companies": companies, "quarterly": quarterly, "annual": annual}
