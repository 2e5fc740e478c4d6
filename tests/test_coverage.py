"""Issuer clusters, reasons and value pools against plain rules, and the rates of the money-weighted return."""

import datetime as dt
import random

import pytest

from asofkit.operators import coverage, perf


@pytest.mark.parametrize("tolerance", [0.0, 0.1])
def test_similar_values(spark, tolerance):
    r = random.Random(1)
    value = lambda: r.choice([None, 0.0, r.uniform(-3, 3), r.uniform(-1e6, 1e6), 100.0, 101.9, 112.0, -100.0, -98.1])
    rows = [(k, r.choice(["a", "b", None]), value()) for k in range(200)]
    pool = [(r.choice(["a", "b", None]), value()) for _ in range(40)]
    out = coverage.similar_values(spark.createDataFrame([(*x, 7.0) for x in rows], "id int, k string, v double, similar_not double"), spark.createDataFrame(pool, "k string, v double"), ["k"], "v", tolerance)
    near = max(tolerance, 0.02)
    expected = [(i, v is not None and any(k == x and y is not None and abs(y - v) <= max(abs(y), abs(v), 1.0) * near for x, y in pool)) for i, k, v in rows]
    assert sorted((x["id"], x["similar"]) for x in out.collect()) == expected


def test_clusters_and_reasons(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=91 * n)
    row = lambda t, n, family, metric="revenue", kind="business", source="xbrl": (t, day(n), family, source, metric, kind)
    rows = [row("both", n, f) for n in range(3) for f in ("filing", "companyfacts")]
    rows += [row("apart", n, "filing") for n in range(3)] + [row("apart", n, "companyfacts") for n in range(3, 6)]
    rows += [row("full", n, "filing", m, kind="geography") for n in range(5) for m in ("revenue", "operating_income")] + [row("revenue", n, "filing", kind=None, source=f"s{n}") for n in range(5)]
    rows += [row("partial", n, "filing", kind=k) for n in range(2) for k in ("product", "geography")] + [row("one", 0, "filing")] + [row("facts", 0, "companyfacts")]
    counts = coverage.issuer_counts(spark.createDataFrame(rows, "ticker string, period_end date, family string, source string, metric string, segment_type string"))
    every = spark.createDataFrame([(t,) for t in ("both", "apart", "full", "revenue", "partial", "one", "facts", "no log", "meta", "nothing")], "ticker string").join(counts, "ticker", "left").fillna(0)
    log = spark.createDataFrame([("no log", None, None, None), ("facts", "b segment_not_found", "html_table_mvp", "fail"), ("facts", "a FileNotFoundError", None, None), ("facts", "c", None, None), ("facts", "c", None, None), ("one", "FileNotFoundError", None, None)], "ticker string, reason string, method string, status string")
    out = coverage.with_poor_reason(coverage.with_clusters(every), log, spark.createDataFrame([("meta",)], "ticker string"))
    got = {r["ticker"]: (r["issuer_cluster"], r["metric_cluster"], r["segment_profile"], r["source_poor_reason"], r["poor_reason_detail"], r["parser_candidate"]) for r in out.collect()}
    assert got == {
        "both": ("companyfacts_overlap", "revenue_only", "business_dominant", None, None, False), "apart": ("segment_source_poor", "revenue_only", "business_dominant", None, None, False),
        "full": ("filing_only_full", "revenue_and_operating_income", "geography_dominant", None, None, False), "revenue": ("filing_only_revenue_only", "revenue_only", "other_dominant", None, None, False),
        "partial": ("filing_only_partial", "revenue_only", "mixed", None, None, False), "one": ("segment_source_poor", "metric_sparse", "business_dominant", None, None, False),
        "facts": ("segment_source_poor", "metric_sparse", "none", "filing_cache_missing", "a FileNotFoundError|b segment_not_found|c", False),
        "no log": ("segment_source_poor", "metric_sparse", "none", "parser_candidate_but_not_materialized", "filings_present_without_segment_rows", True),
        "meta": ("segment_source_poor", "metric_sparse", "none", "parser_candidate_but_not_materialized", "filings_present_without_segment_rows", True),
        "nothing": ("segment_source_poor", "metric_sparse", "none", "source_unavailable", "no_filing_meta_or_segment_logs", False),
    }
    codes = {r["ticker"]: r["c"] for r in out.select("ticker", coverage.reason_codes().alias("c")).collect()}
    assert codes["apart"] == ["no_companyfacts_filing_overlap", "operating_income_sparse", "single_filing_source", "segment_type_business_dominant"]
    assert codes["revenue"] == ["companyfacts_missing_filing_present", "operating_income_sparse", "segment_type_other_dominant"]
    assert codes["nothing"] == ["source_poor_source_unavailable", "segment_source_missing"]


def test_distributions_count_values_and_entries(spark):
    df = spark.createDataFrame([("a", None, ["x", "x", "y"]), ("a", "q", []), ("b", None, None)], "c string, d string, l array<string>")
    got = sorted((r["dimension"], r["value"], r["n"], round(r["rate"], 3)) for r in coverage.distributions(df, ["c", "d"], ["l"]).collect())
    assert got == [("c", "a", 2, 0.667), ("c", "b", 1, 0.333), ("d", "q", 1, 0.333), ("l", "x", 1, 0.333), ("l", "y", 1, 0.333)]


@pytest.mark.parametrize("rate, found", [(-0.995, True), (-0.9995, False), (-0.3, True), (0.0, True), (7.5, True), (10.0, True), (12.0, False)])
def test_money_weighted_roots_within_the_rates(spark, rate, found):
    first = dt.date(2020, 1, 1)
    days = 200
    worth = 1000 * (1 + rate) ** (days / 365.25)
    df = spark.createDataFrame([("a", first, -1000.0), ("a", first + dt.timedelta(days=days), worth)], "account string, date date, amount double")
    got = perf.money_weighted(df, ["account"]).first()["mwr"]
    assert got == pytest.approx(rate, abs=1e-7) if found else got is None
