"""The blocked scan against a plain recurrence over whole histories."""

import datetime as dt
import random

import pandas as pd
import pytest

from asofkit.operators import scan

DAY = dt.date(2000, 1, 1)
SCHEMA = "k string, date date, x double, other int"


def plain(values, span):
    return [None if pd.isna(v) else v for v in pd.Series(values, dtype=float).ewm(span=span, adjust=False).mean()]


@pytest.mark.parametrize("days", [1, 7, 64, 5000])
def test_blocks_of_any_size_give_the_plain_means(spark, days):
    rng = random.Random(days)
    series = {}
    for key, n, missing in (("a", 300, 0.0), ("b", 300, 0.4), (None, 120, 0.9), ("empty", 40, 1.0), ("one", 1, 0.0)):
        at = sorted(rng.sample(range(900), n))
        series[key] = [(DAY + dt.timedelta(days=d), None if rng.random() < missing else rng.uniform(-5, 50)) for d in at]
    rows = [(k, d, x, 0) for k, own in series.items() for d, x in own]
    rng.shuffle(rows)
    out = scan.exponential_means(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"], "x", {"fast": 2, "slow": 26}, days=days)
    assert out.columns == ["k", "date", "x", "fast", "slow"]
    got = {}
    for r in out.collect():
        got.setdefault(r["k"], []).append(tuple(r)[1:])
    assert set(got) == set(series)
    for key, own in series.items():
        mine = sorted(got[key], key=lambda r: r[0])
        assert [r[:2] for r in mine] == own
        for k, span in ((2, 2), (3, 26)):
            expected = plain([x for _, x in own], span)
            assert [r[k] is None for r in mine] == [v is None for v in expected]
            assert [r[k] or 0.0 for r in mine] == pytest.approx([v or 0.0 for v in expected], rel=1e-9, abs=1e-9)


def test_seed_ties_and_rows_without_date(spark, rows):
    df = spark.createDataFrame([("a", None, 1.0, 0), ("a", DAY, 4.0, 0), ("a", DAY, 2.0, 0), ("a", DAY, 2.0, 1)], SCHEMA)
    out = scan.exponential_means(df, ["k"], "x", {"e": 3})
    assert rows(out.select("x", "e"), "x", "e") == [(1.0, 1.0), (2.0, 1.5), (2.0, 1.75), (4.0, 2.875)]
    assert scan.exponential_means(df.limit(0), ["k"], "x", {"e": 3}).collect() == []
    assert rows(scan.exponential_means(df, [], "x", {"e": 1}).select("e"), "e") == [(1.0,), (2.0,), (2.0,), (4.0,)]


def test_one_long_history_is_many_blocks(spark):
    n = 20_000
    df = spark.range(n).selectExpr("'a' AS k", "date_add(DATE'1970-01-01', CAST(id AS INT)) AS date", "CAST(id % 97 AS DOUBLE) AS x")
    out = scan.exponential_means(df, ["k"], "x", {"e": 12}).orderBy("date").select("e").toPandas()["e"].tolist()
    assert out == pytest.approx(plain([float(i % 97) for i in range(n)], 12), rel=1e-9)
