"""Hand-made frames for the awkward window semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from asofkit.functions import windows as win
from asofkit.operators import screen
from asofkit.operators import statements as st


def quarters(spark, values, key="a"):
    rows = [(key, dt.date(2020 + k // 4, 3 * (k % 4) + 3, 28), 2020 + k // 4, k % 4 + 1, v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, period_end date, fiscal_year int, fiscal_quarter int, x double")


@pytest.mark.parametrize(
    ("mode", "expected"),
    [("lenient", [1.0, 1.0, 4.0, 4.0, 8.0, 14.0]), ("strict", [None] * 6), ("partial", [4.0, 4.0, 8.0, 8.0, 16.0, 56 / 3])],
)
def test_ttm_with_nulls(spark, rows, mode, expected):
    df = quarters(spark, [1.0, None, 3.0, None, 5.0, 6.0])
    got = [r[0] for r in rows(df.select(win.ttm("x", win.by("ticker", order="period_end"), mode).alias("y"), "period_end"), "period_end")]
    assert got == pytest.approx(expected)


def test_average_rank_of_ties(spark, rows):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 1.0), ("d", "c", 2.0), ("d", "e", None)], "date string, ticker string, x double")
    out = df.select("ticker", win.avg_rank("x", ["date"]).alias("r"), win.pct_rank("x", ["date"]).alias("p"))
    assert rows(out, "ticker") == [("a", 1.5, 0.5), ("b", 1.5, 0.5), ("c", 3.0, 1.0), ("e", None, None)]


def test_rsi_without_losses_is_null(spark, rows):
    df = quarters(spark, [1.0, 2.0, 3.0, 4.0]).withColumn("c", F.lit(1.0))
    assert {r[0] for r in rows(df.select(win.rsi("x", win.by("ticker", order="period_end"), 2, "c")))} == {None}


def test_total_loss_stays_in_the_running_product(spark, rows):
    df = quarters(spark, [0.1, -1.0, 0.5])
    out = df.select("period_end", win.running_product(1 + F.col("x"), win.by("ticker", order="period_end")).alias("y"))
    assert [r[1] for r in rows(out, "period_end")] == pytest.approx([1.1, 0.0, 0.0])


def test_decumulated_quarters(spark, rows):
    df = quarters(spark, [10.0, 25.0, 45.0, 70.0])
    assert [r[1] for r in rows(df.select("period_end", st.decumulate(df, "x").alias("q")), "period_end")] == [10.0, 15.0, 20.0, 25.0]
    voted = st.decumulate_voted(df, "x", "q")
    assert [r[1] for r in rows(voted.select("period_end", "q"), "period_end")] == [10.0, 15.0, 20.0, 25.0]
    plain = st.decumulate_voted(quarters(spark, [10.0, 11.0, 12.0, 13.0]), "x", "q")
    assert [r[1] for r in rows(plain.select("period_end", "q"), "period_end")] == [10.0, 11.0, 12.0, 13.0]


def test_partial_year_has_a_sum_but_is_no_complete_year(spark, rows):
    df = quarters(spark, [1.0, 2.0, 3.0]).withColumn("available_date", F.col("period_end"))
    assert rows(st.annual_calendar(df, ["x"], []).select("x")) == [(6.0,)]
    assert rows(st.annual_complete(df, ["x"], [])) == []


def test_leading_annual_rows_go(spark, rows):
    df = spark.createDataFrame([("a", dt.date(2019, 12, 31), 4, "FY", 100.0), ("a", dt.date(2020, 3, 31), 1, "10-Q", 10.0), ("a", dt.date(2020, 12, 31), 4, "FY", 20.0)], "ticker string, period_end date, fiscal_quarter int, form string, x double")
    assert [r[0] for r in rows(st.drop_leading_annual(df).select("x"), "x")] == [10.0, 20.0]


def test_split_jumps_are_mended(spark):
    values = F.array(*map(F.lit, (100.0, 101.0, 405.0, 102.0, 103.0)))
    assert spark.range(1).select(st.mend_split_jumps(values)).first()[0] == pytest.approx([100, 101, 101.25, 102, 103])


def test_weights_are_capped_and_scaled_only_above_one(spark, rows):
    df = spark.createDataFrame([("d", "a", 3.0), ("d", "b", 1.0), ("e", "a", -1.0), ("e", "b", -2.0)], "date string, ticker string, score double")
    out = {r[:2]: r[2] for r in rows(screen.weighted(df, True, 0.5).select("date", "ticker", "weight"))}
    assert out == pytest.approx({("d", "a"): 0.5, ("d", "b"): 0.25, ("e", "a"): 0.5, ("e", "b"): 0.5})


def test_conditions_decide_nulls(spark, rows):
    df = spark.createDataFrame([(1, 5.0, None), (2, -1.0, 3.0)], "id int, x double, y double")
    out = screen.with_conditions(df, {"a": "x > 0", "b": "y > 0"}, "a OR b")
    assert rows(out.select("id", "selected", "passed", "failed"), "id") == [(1, True, ["a"], ["b"]), (2, True, ["b"], ["a"])]
    assert rows(screen.with_conditions(df, {"b": "y > 0"}, on_null="pass").select("id", "selected"), "id") == [(1, True), (2, True)]


def test_frame_functions_stand_once(spark):
    """RSI and Bollinger run each function once over a row's frame."""
    rows = spark.createDataFrame([("a", k, float(k * k % 7), float(k % 5 - 2)) for k in range(30)], "ticker string, date int, close double, chg double")
    w = win.by("ticker")
    plan = rows.select(win.rsi("close", w, 14, "chg").alias("r"), win.bollinger_z("close", w).alias("b"))._jdf.queryExecution().analyzed().toString()
    found = [x for x in plan.splitlines() if "Window [" in x]
    assert sum(x.count("windowspecdefinition") for x in found) == 6, found
