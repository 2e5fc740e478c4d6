"""Two sources, performance, quality and sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from asofkit.functions import columns as col
from asofkit.operators import perf, quality, reconcile
from asofkit.sources import io
from asofkit.streaming import streams


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_safe_div_never_raises(spark):
    r = spark.createDataFrame([(1.0, 0.0), (1.0, -2.0), (1.0, 2.0)], "n double, d double")
    assert [x[0] for x in r.select(col.safe_div("n", "d")).collect()] == [None, -0.5, 0.5]
    assert [x[0] for x in r.select(col.safe_div("n", "d", True)).collect()] == [None, None, 0.5]


def test_first_valid_by_row_and_by_column(spark, rows):
    df = spark.createDataFrame([("a", 1, None, 5.0), ("a", 2, 7.0, 6.0), ("b", 3, None, 8.0)], "k string, i int, x double, y double")
    out = df.select("i", col.first_valid("x", "y").alias("r"), col.first_valid_column(["k"], "x", "y").alias("c"))
    assert rows(out, "i") == [(1, 5.0, None), (2, 7.0, 7.0), (3, 8.0, 8.0)]


def test_comparison_ladder(spark, rows):
    left = spark.createDataFrame([(1, "m", 100.0), (2, "m", 100.0), (3, "m", 5.0), (5, "m", 10.0)], "k int, metric string, value double")
    right = spark.createDataFrame([(1, "m", 101.0), (2, "m", 150.0), (4, "m", 5.0), (5, "m", -10.0)], "k int, metric string, value double")
    policy = spark.createDataFrame([("m", "relative", 0.02, "as_is", 1.0)], "metric string, kind string, tolerance double, sign_rule string, scale double")
    out = reconcile.compare(left, right, ["k"], policy)
    assert rows(out.select("k", "status", "sign_mismatch"), "k") == [(1, "match", False), (2, "breach", False), (3, "missing_right", False), (4, "missing_left", False), (5, "breach", True)]


def test_shifted_sequences_align(spark, rows):
    a = spark.createDataFrame([("x", day(90 * k)) for k in range(6)], "t string, d date")
    b = spark.createDataFrame([("x", day(90 * k + 2)) for k in range(1, 6)], "t string, d date")
    assert rows(reconcile.sequence_aligned(a, b, "t", "d", 10)) == [("x", -1, 5)]


def test_curve_edges(spark, rows):
    df = spark.createDataFrame([("one", day(0), 5.0), *(("flat", day(k), 7.0) for k in range(3)), ("lost", day(0), 10.0), ("lost", day(1), 0.0)], "p string, date date, equity double")
    out = {r["p"]: r for r in perf.account_metrics(df, ["p"]).collect()}
    assert out["one"]["vol"] == out["flat"]["sharpe"] == 0.0 and out["flat"]["mdd"] == 0.0 and out["lost"]["mdd"] == -1.0 and out["lost"]["cagr"] is None


def test_money_weighted_return(spark):
    flows = spark.createDataFrame([("a", day(0), -100.0), ("a", day(0) + dt.timedelta(days=365), 110.0), ("b", day(0), -1.0), ("b", day(9), -1.0)], "k string, date date, amount double")
    out = {r["k"]: r["mwr"] for r in perf.money_weighted(flows, ["k"]).collect()}
    assert out["a"] == pytest.approx(0.1, abs=1e-3) and out["b"] is None


def test_profiles(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (1, "c")], "k int, v string")
    assert rows(quality.duplicate_rows(df, ["k"])) == [(2,)]
    assert rows(quality.null_rates(df, ["k", "v"]), "column") == [("k", 4, 4, 0, 0.0), ("v", 4, 3, 1, 0.25)]
    assert rows(quality.duplicate_rows(df.limit(0), ["k"])) == [(0,)]


def test_nested_facts_and_partition_keys(spark, rows, tmp_path):
    doc = '{"facts": {"gaap": {"Revenue": {"units": {"USD": [{"start": "2024-01-01", "end": "2024-03-31", "val": 5, "form": "10-Q", "filed": "2024-05-01"}, {"val": 6}]}}}}}'
    out = io.company_facts(spark.createDataFrame([("a", doc)], "ticker string, json string"))
    assert rows(out.select("concept", "unit", "period_end", "value")) == [("Revenue", "USD", dt.date(2024, 3, 31), 5.0)]
    path = str(tmp_path / "t")
    io.replace(spark.createDataFrame([("005930", 1), ("000660", 2)], "ticker string, x int"), path, ["ticker"])
    io.replace_partitions(spark.createDataFrame([("000660", 3)], "ticker string, x int"), path, ["ticker"])
    assert rows(io.read_partitioned(spark, path).select("ticker", "x"), "ticker") == [("000660", 3), ("005930", 1)]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).select("id", (F.col("id") * 2).alias("x"), F.lit("z").alias("y")).write.parquet(path)
    df = io.read_table(spark, path, ["x", "none"], [("id", ">=", 10), ("id", "in", [11, 12])])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 2 and "PushedFilters: [" in plan and "y" not in plan.partition("ReadSchema")[2].split("\n")[0]


def test_incremental_load_resumes(spark, rows, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for batch in ([(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)]):
        spark.createDataFrame(batch, "k int, v string, n int").coalesce(1).write.mode("append").parquet(source)
        streams.load(streams.source(spark, source, "k int, v string, n int"), state, streams.upsert_into(out, ["k"], "n"))
    assert rows(spark.read.parquet(f"{out}/v=1").select("k", "v"), "k") == [(1, "a"), (2, "c"), (3, "d")]


def test_sources_are_read_once(spark):
    """The second source derives from the facts of the first, so neither table of lines is read twice."""
    from asofkit.plans import catalog

    for name in ("reconcile_report", "reconcile_sources", "consensus", "coverage_survey"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_suppkey#") and sum("Relation [" in x and "l_suppkey" in x for x in plan.splitlines()) == 1, name


def test_one_table_compares_like_two(spark):
    """Nulls are keys of their own; a row without a value, or of one source alone, is missing on that side."""
    schema = "k string, metric string, value double"
    left = spark.createDataFrame([("a", "m", 1.0), ("b", "m", None), (None, "m", 3.0), ("c", "n", 4.0)], schema)
    right = spark.createDataFrame([("a", "m", -1.0), ("b", "m", 2.0), (None, "m", 3.0), ("d", None, 5.0)], schema)
    policy = spark.createDataFrame([("m", "relative", 0.02, "as_is", 1.0)], "metric string, kind string, tolerance double, sign_rule string, scale double")
    both = left.withColumn("source", F.lit("x")).unionByName(right.withColumn("source", F.lit("y")))
    one, two = reconcile.compare_sources(both, ["k"], "source", ("x", "y"), policy), reconcile.compare(left, right, ["k"], policy)
    assert sorted(one.columns) == sorted(two.columns)
    assert sorted(map(str, one.select(*two.columns).collect())) == sorted(map(str, two.collect()))


def test_trades_with_their_equity(spark):
    """Equity within the trades' rows gives what a curve beside them gives, and the query reads its lines once."""
    from asofkit.plans import catalog

    rows = spark.createDataFrame([("a", "buy", 10.0, None, 4.0), ("a", "sell", -6.0, 2.0, 12.0), ("b", "sell", 1.0, -1.0, None), (None, "buy", 3.0, None, 6.0)], "k string, side string, notional double, realized_pnl double, equity double")
    assert sorted(map(tuple, perf.trade_metrics(rows, None, ["k"]).collect()), key=str) == [("a", 2.0, 1.0, 2.0), ("b", None, 0.0, -1.0), (None, 0.5, None, None)]
    plan = catalog.queries()["trade_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in x and "l_suppkey" in x for x in plan.splitlines()) == 1


def test_own_bands_need_no_join(spark):
    """Bands of rows that hold eps and multiple are those of both tables joined, and the whole payload reads its lines twice at most."""
    from asofkit.operators import facts
    from asofkit.plans import catalog

    rows = spark.createDataFrame([("a", k, 1.0 + k, float(k - 2)) for k in range(14)] + [("b", 1, 2.0, None), (("c"), 1, None, 3.0)], "ticker string, n int, eps double, per double")
    one, two = facts.own_price_bands(rows, "per"), facts.price_bands(rows, "per", rows.drop("per"))
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    plan = catalog.queries()["valuation_payload"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in x and "l_suppkey" in x for x in plan.splitlines()) == 2  # statements and prices
