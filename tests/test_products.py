"""Product names, units and values of two sources."""

import datetime as dt

from pyspark.sql import functions as F

from asofkit.operators import products

D = dt.date(2024, 12, 31)


def test_names_and_units(spark):
    rows = [("DX-TV (대)", "대", "", "대"), ("시멘트 부문  A공장", "천 Ton, %", "생산능력", "ton"), (None, None, None, None), ("A&crB – c", "백만원", "x", "ton"), ("x", "억원", "가동률", "kl"), ("x", "시간, C/S", "x", ""), ("x", "개", "x", "원")]
    df = spark.createDataFrame(rows, "n string, u string, s string, e string").withColumn("i", F.monotonically_increasing_id())
    got = [tuple(r) for r in df.orderBy("i").select(products.product_key("n"), products.unit_scale("u", "s"), products.comparable("u", "s", "e")).collect()]
    assert got == [("dx tv", 1.0, True), ("시멘트 a", 1e3, True), (None, 1.0, True), ("a b c", 1e6, False), ("x", 1.0, True), ("x", 1.0, False), ("x", 1.0, False)]


def test_the_best_name_wins(spark):
    left = [("k", "s", n, D, v) for n, v in (("시멘트전용선", 1.0), ("삼척 시멘트", 2.0), ("steel", 1.2), ("steel long product", 5.0), ("pipe", 60.0), ("a", 1.0), ("none", 1.0), ("silent", None))] + [("k", "t", "steel", D, 1.0)]
    right = [("k", "s", n, D, v, u) for n, v, u in (("시멘트", 3.0, "톤"), ("steel", 1.0, "톤"), ("steel 합계", 2.0, "톤"), ("long", 5.0, "톤"), ("pipe (b)", 50.0, "톤"), ("pipe (a)", 61.0, "톤"), ("pipe (c)", 7.0, "톤"), ("silent (b)", 1.0, None), ("silent (a)", None, None))]
    frames = spark.createDataFrame(left, "k string, section string, name string, period date, value double"), spark.createDataFrame(right, "k string, section string, name string, period date, value double, unit string")
    matches = products.matched_products(*frames, ["k", "section"])
    plan = matches._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan
    got = {r["name"]: (r["match"], r["overlap"]) for r in matches.collect()}
    assert got == {
        "삼척 시멘트": ("시멘트", 3),  # at a word; within 시멘트전용선 it is half of one
        "steel": ("steel", 5),  # nearer than the total, which overlaps as far; too little of the long name
        "pipe": ("pipe (a)", 4), "silent": ("silent (a)", 6),
    }
    errors = products.product_errors(frames[0].withColumn("expected", F.lit("톤")), frames[1], matches, ["k", "section"]).collect()
    assert {(r["name"], r["value"], r["matched_value"]) for r in errors} == {("삼척 시멘트", 2.0, 3.0), ("steel", 1.2, 1.0), ("pipe", 60.0, 61.0)}
