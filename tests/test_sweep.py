"""Interval pieces, lookups and overlaps against brute force, with a key of many intervals, and their plans."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from asofkit.operators import intervals, quality, sweep

INTERVALS = "k string, valid_from date, valid_to date, v string, p int"


def day(n):
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


def made(seed, n, keys="abc", most=300):
    r = random.Random(seed)
    rows = [(r.choice(keys), day(a), r.choice([None, day(a + r.randrange(40)), day(a + r.randrange(most))]), f"v{r.randrange(9)}", r.randrange(3)) for a in (r.randrange(most) for _ in range(n))]
    return [*rows, ("a", None, day(9), "no start", 0), (None, day(1), day(9), "no key", 0), ("b", day(9), day(3), "reversed", 0), ("z", day(5), day(5), "one day", 1)]


def last(z):
    return z or dt.date(9999, 12, 31)


def covering(rows, k, d):
    return [r for r in rows if r[0] == k and k is not None and d is not None and r[1] is not None and r[1] <= d <= last(r[2])]


@pytest.mark.parametrize("seed, n", [(1, 4), (2, 60), (3, 400)])
def test_rows_find_their_best_interval(spark, seed, n):
    spans = made(seed, n)
    asked = [(i, k, d) for i, (k, d) in enumerate([(k, day(x)) for k in "abcz" for x in range(-5, 320, 7)] + [("y", day(3)), (None, day(3)), ("a", None), ("a", dt.date(9999, 12, 31)), ("a", dt.date(1, 1, 1))] * 2)]
    rows = spark.createDataFrame([(*r, "x") for r in asked], "i int, k string, d date, valid_from string")
    out = intervals.point_in_interval(rows, spark.createDataFrame(spans, INTERVALS), ["k"], "d", ["v", "p"], [F.col("p").desc(), F.col("v")])
    assert out.columns == ["i", "k", "d", "valid_from", "v", "p"]
    expected = []
    for i, k, d in asked:
        found = sorted(covering(spans, k, d), key=lambda r: (-r[1].toordinal(), -r[4], r[3]))
        expected.append((i, *((found[0][3], found[0][4]) if found else (None, None))))
    assert sorted((r["i"], r["v"], r["p"]) for r in out.collect()) == sorted(expected, key=lambda r: r[0])


@pytest.mark.parametrize("seed, n", [(4, 5), (5, 300)])
def test_overlaps_are_found_once(spark, monkeypatch, seed, n):
    monkeypatch.setattr(sweep, "BIN_POINTS", 8)
    one, two = made(seed, n), made(seed + 50, n // 2)
    frames = [spark.createDataFrame([(*r[:3], i) for i, r in enumerate(x)], f"k string, valid_from date, valid_to date, {c} int") for x, c in ((one, "i"), (two, "j"))]
    got = sorted(map(tuple, intervals.overlap_join(*frames, ["k"], ["i"], ["j"]).collect()))
    good = lambda r: r[0] is not None and r[1] is not None and r[1] <= last(r[2])
    expected = [(a[0], i, j, max(a[1], b[1]), None if a[2] is None and b[2] is None else min(last(a[2]), last(b[2]))) for i, a in enumerate(one) for j, b in enumerate(two) if good(a) and good(b) and a[0] == b[0] and a[1] <= last(b[2]) and b[1] <= last(a[2])]
    assert got == sorted(expected)


def test_overrides_day_by_day(spark):
    spans = [r for r in made(6, 120, "ab") if r[2] is not None]
    base = spark.createDataFrame([("a", day(0), day(200), "base"), ("b", day(50), None, "base"), ("c", day(0), day(1), "base")], "k string, valid_from date, valid_to date, v string")
    out, plain = intervals.with_overrides(base, spark.createDataFrame(spans, INTERVALS), ["k"], "v").collect(), base.collect()
    for k in "abcz":
        own = sorted((r for r in out if r["k"] == k), key=lambda r: r["valid_from"])
        assert all(last(a["valid_to"]) < b["valid_from"] for a, b in zip(own, own[1:], strict=False))
        assert all(a["v"] != b["v"] or last(a["valid_to"]) + dt.timedelta(days=1) < b["valid_from"] for a, b in zip(own, own[1:], strict=False))
        for x in range(-3, 420):
            found = sorted(covering(spans, k, day(x)), key=lambda r: (-r[1].toordinal(), r[3]))
            under = [b for b in plain if b["k"] == k and b["valid_from"] <= day(x) <= last(b["valid_to"])]
            got = [r["v"] for r in own if r["valid_from"] <= day(x) <= last(r["valid_to"])]
            assert got == ([found[0][3]] if found else [u["v"] for u in under]), (k, x)


def test_distances_to_validity(spark):
    spans = made(7, 12, "ab", 2000)
    asked = [(i, k, d) for i, (k, d) in enumerate([(k, day(x)) for k in "abz" for x in range(-50, 2100, 13)] + [("y", day(1)), ("a", None), (None, day(1))])]
    out = quality.outside_validity(spark.createDataFrame(asked, "i int, k string, d date"), spark.createDataFrame(spans, INTERVALS), "k", "d", "i", 5, 60)
    expected = []
    for i, k, d in asked:
        own = [r for r in spans if r[0] == k and r[0] is not None and r[1] is not None and r[1] <= last(r[2])]
        gap = min((max((r[1] - d).days, (d - last(r[2])).days, 0) for r in own), default=None) if d else None
        expected.append((i, gap, len(covering(own, k, d)), "missing" if gap is None else "pass" if gap <= 5 else "warn" if gap <= 60 else "fail"))
    assert sorted((r["i"], r["days"], r["covering"], r["status"]) for r in out.collect()) == expected


def test_no_rows(spark):
    none = spark.createDataFrame([], INTERVALS)
    rows = spark.createDataFrame([(1, "a", day(0))], "i int, k string, d date")
    assert intervals.point_in_interval(rows, none, ["k"], "d", ["v"], []).collect()[0]["v"] is None
    assert intervals.point_in_interval(rows.limit(0), none, ["k"], "d", ["v"], []).count() == 0
    assert intervals.overlap_join(none, none, ["k"], ["v"], ["p"]).count() == intervals.with_overrides(none, none, ["k"], "v").count() == 0
    assert quality.outside_validity(rows, none, "k", "d", "i", 5, 60).first()["status"] == "missing"


def _ranges(df):
    """Join conditions of the plan that compare by order."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if re.search(r"\bJoin\b", x) and re.search(r" [<>]=? ", x)]


def test_a_key_with_many_rows_and_intervals(spark):
    """100,000 rows and 1,000 intervals of one key: no range join, and no task holds the key's rows alone."""
    r = random.Random(8)
    spans = [("hot", day(a), day(a + r.choice([5, 50, 4000])), f"v{a % 7}", i) for i, a in ((i, r.randrange(6000)) for i in range(1000))]
    every = spark.createDataFrame(spans, INTERVALS)
    rows = spark.range(100_000).select(F.col("id"), F.when(F.col("id") >= 0, "hot").alias("k"), F.date_add(F.lit(day(0)), (F.col("id") % 7000).cast("int")).alias("d"))
    out = intervals.point_in_interval(rows, every, ["k"], "d", ["p"], [F.col("p")])
    assert _ranges(out) == []
    assert _ranges(quality.outside_validity(rows, every, "k", "d", "id", 5, 60)) == []
    best = {}
    for x in range(7000):
        best[x] = max(((s[1], -s[4]) for s in spans if s[1] <= day(x) <= s[2]), default=None)
    got = out.select((F.col("id") % 7000).alias("x"), "p").distinct().collect()
    assert len(got) == 7000 and all(r["p"] == (best[r["x"]] and -best[r["x"]][1]) for r in got)
    keyed = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x and "__found" in x]
    assert keyed and all("__bin" in x for x in keyed)


@pytest.mark.parametrize("binned", [True, False])
def test_pieces_across_small_batches(spark, monkeypatch, binned):
    """Intervals stay from one batch of the ordered pass to the next; the order may name a column that is not returned."""
    monkeypatch.setattr(sweep, "BIN_DAYS", 8)
    spans = made(9, 300)
    asked = [(k, day(x)) for k in "abcz" for x in range(-5, 320) if not binned or x % 50 < 9]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        every, rows = spark.createDataFrame(spans, INTERVALS), spark.createDataFrame(asked, "k string, d date")
        order = [F.col("__a").desc(), F.col("p").desc(), F.col("v")]
        if binned:
            got = sweep.in_best(rows, every, ["k"], "d", order, ["v"]).collect()
        else:
            pieces = sorted(sweep.best_pieces(every, ["k"], order, ["v"]).collect(), key=lambda r: (r["k"], r["__from"]))
            assert all(a["__from"] <= a["__to"] and (a["k"] != b["k"] or a["__to"] < b["__from"]) for a, b in zip(pieces, pieces[1:], strict=False))
            got = sweep.in_pieces(rows, sweep.best_pieces(every, ["k"], order, ["v"]), ["k"], "d", ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = lambda k, d: min(((-s[1].toordinal(), -s[4], s[3]) for s in covering(spans, k, d)), default=(None,))[-1]
    assert sorted(map(tuple, got), key=repr) == sorted(((k, d, best(k, d)) for k, d in asked), key=repr)


def test_lookup_shuffles_rows_and_intervals_once(spark):
    """No join at any size: the bins of the rows, the intervals with these bins, and the rows with their pieces are shuffled, each once."""
    rows = spark.range(10).select(F.col("id"), F.lit("a").alias("k"), F.lit(day(3)).alias("d"))
    out = intervals.point_in_interval(rows, spark.createDataFrame(made(10, 50), INTERVALS), ["k"], "d", ["v"], [F.col("v")])
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Join" not in plan and len(re.findall(r"\bExchange\b", plan)) == 3, plan


def test_many_nested_and_open_intervals_of_one_key(spark):
    """20,000 intervals of one key, nested and open: the latest start comes first."""
    n = 10_000
    spans = spark.range(n).select(F.lit("hot").alias("k"), F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("valid_from"), F.explode(F.array(F.date_add(F.lit(day(3 * n)), -F.col("id").cast("int")), F.lit(None).cast("date"))).alias("valid_to"), F.col("id").alias("v"))
    closed = spans.where("valid_to IS NOT NULL")
    rows = spark.range(3 * n).select(F.lit("hot").alias("k"), F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("d"), F.col("id"))
    got = {r["id"]: r["v"] for r in intervals.point_in_interval(rows, closed, ["k"], "d", ["v"], [F.col("v")]).collect()}
    assert got == {x: min(x, n - 1, 3 * n - x) for x in range(3 * n)}
    last = intervals.point_in_interval(rows, spans, ["k"], "d", ["v"], [F.col("v")]).where(F.col("v") != F.least(F.col("id"), F.lit(n - 1)))
    assert last.count() == 0
