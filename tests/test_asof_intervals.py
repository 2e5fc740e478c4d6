"""As-of joins, restatements and intervals on a few rows each."""

import datetime as dt

from pyspark.sql import functions as F

from asofkit.operators import asof, dedupe, intervals
from asofkit.operators import statements as st


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def prices(spark, n=6):
    return spark.createDataFrame([("a", day(k), 10.0 + k) for k in range(n)], "ticker string, date date, close double")


def test_each_column_keeps_its_own_last_value(spark, rows):
    facts = spark.createDataFrame([("a", day(1), 1.0, 5.0), ("a", day(3), None, 6.0)], "ticker string, available_date date, eps double, revenue double")
    out = asof.asof_columns(prices(spark), facts, ["ticker"], "date", "available_date", ["eps", "revenue"], "seen")
    assert [r[1:] for r in rows(out.select("date", "eps", "revenue", "seen"), "date")] == [(None, None, None), (1.0, 5.0, day(1)), (1.0, 5.0, day(1)), (1.0, 6.0, day(3)), (1.0, 6.0, day(3)), (1.0, 6.0, day(3))]
    row = asof.asof_row(prices(spark), facts, ["ticker"], "date", "available_date", ["eps"])
    assert [r[1] for r in rows(row.select("date", "eps"), "date")] == [None, 1.0, 1.0, None, None, None]


def test_past_the_bound_stands_the_default(spark, rows):
    right = spark.createDataFrame([("a", day(0), None, "old"), ("a", day(2), day(3), "new")], "ticker string, f date, t date, v string")
    out = asof.asof_bounded(prices(spark), right, ["ticker"], "date", "f", "t", ["v"], "none")
    assert [r[1] for r in rows(out.select("date", "v"), "date")] == ["old", "old", "new", "new", "none", "none"]


def test_next_row_and_beyond_the_calendar(spark, rows):
    calendar = spark.createDataFrame([(day(1),), (day(5),), (day(40),), (dt.date(2025, 2, 3),)], "d date")
    left = spark.createDataFrame([(1, day(0)), (2, day(1)), (3, day(10)), (4, dt.date(2024, 12, 30)), (5, dt.date(2025, 3, 1))], "id int, x date")
    out = asof.next_row(left, calendar, "x", "d", "n")
    assert [r[1] for r in rows(out.select("id", "n"), "id")] == [day(1), day(5), day(40), dt.date(2025, 2, 3), None]


def test_restatement_changes_the_panel_from_its_own_date(spark, rows):
    filings = spark.createDataFrame([("a", dt.date(2023, 12, 31), day(10), day(10), 1, 7.0), ("a", dt.date(2023, 12, 31), day(40), day(40), 2, 9.0)], "ticker string, period_end date, available_date date, filing_date date, version int, x double")
    out = st.revision_panel(filings, ["x"], quarters=1)
    assert [tuple(r)[1:] for r in out.select("ticker", "event_date", "x_ttm").orderBy("event_date").collect()] == [(day(10), 7.0), (day(40), 9.0)]


def test_events_to_intervals(spark, rows):
    events = spark.createDataFrame([("a", day(0), "add", 1), ("a", day(5), "add", 2), ("a", day(9), "remove", 3), ("b", day(2), "remove", 4), ("b", day(3), "add", 5), ("c", day(3), "add", 6), ("c", day(3), "remove", 7)], "ticker string, date date, action string, event_id int")
    assert rows(intervals.events_to_intervals(events, ["ticker"]), "ticker", "valid_from") == [("a", day(0), day(4)), ("a", day(5), day(8)), ("b", day(3), None), ("c", day(3), None)]
    assert [(r["ticker"], r["issue"]) for r in intervals.event_issues(events, ["ticker"]).orderBy("ticker").collect()] == [("b", "remove_without_add"), ("c", "remove_without_add")]


def test_merge_overlap_and_override(spark, rows):
    spans = spark.createDataFrame([("a", day(0), day(4), "x"), ("a", day(5), day(9), "x"), ("a", day(20), None, "y")], "ticker string, valid_from date, valid_to date, v string")
    assert rows(intervals.merged(spans, ["ticker"]), "valid_from") == [("a", day(0), day(9)), ("a", day(20), None)]
    assert rows(intervals.overlaps(spans, ["ticker"])) == []
    inner = spark.createDataFrame([("a", day(22), day(24), "z")], "ticker string, valid_from date, valid_to date, v string")
    out = intervals.with_overrides(spans.where("v = 'y'"), inner, ["ticker"], "v").select("v", "valid_from", "valid_to")
    assert rows(out, "valid_from") == [("y", day(20), day(21)), ("z", day(22), day(24)), ("y", day(25), None)]


def test_merge_keeps_null_keys_apart(spark, rows):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "c"), (3, "d")], "k int, v string")
    assert rows(dedupe.merge(old, new, ["k"]).orderBy(F.col("k").asc_nulls_last())) == [(1, "a"), (3, "d"), (None, "c")]


def test_latest_prefers_a_null_date(spark, rows):
    df = spark.createDataFrame([("a", day(0), day(9), 1), ("a", day(0), None, 2)], "ticker string, available_date date, filing_date date, n int")
    assert [r["n"] for r in dedupe.latest_as_of(df, "ticker", F.lit(day(50)), order=("filing_date",)).collect()] == [2]


def test_revisions_against_what_was_known(spark):
    """Random filings, late ones for periods long past, equal dates, missing values and dates; one key with most of the rows."""
    import random

    r = random.Random(5)
    filings = []
    for n in range(900):
        q = r.randrange(14)
        filed = r.choice([None, day(91 * q + r.randrange(10, 900))])
        filings.append((r.choice("aaaaaaabc"), day(91 * q), r.choice([filed, day(91 * q + r.randrange(10, 900))]), filed, n, r.choice([None, float(r.randrange(100))] + [float(n)] * 6)))
    filings += [(None, day(0), day(9), day(9), 1, 1.0), ("a", None, day(9), day(9), 1, 1.0), ("a", day(0), None, day(9), 1, 1.0)]
    df = spark.createDataFrame(filings, "ticker string, period_end date, available_date date, filing_date date, version int, x double")
    good = [f for f in filings if None not in f[:3]]
    expected = []
    for t, event in sorted({(f[0], f[2]) for f in good}):
        held = {}
        for f in sorted((f for f in good if f[0] == t and f[2] <= event), key=lambda f: (f[2], f[1], f[3] is not None, f[3] or day(0), f[4])):
            order = (f[3] is not None, f[3] or day(0), f[2])
            if f[1] not in held or order >= held[f[1]][0]:
                held[f[1]] = (order, f[5])
        last = [held[p][1] for p in sorted(held)[-4:]]
        expected.append((t, event, max(held), sum(last) if len(last) == 4 and None not in last else None))
    assert sorted(tuple(x) for x in st.revision_panel(df, ["x"]).collect()) == expected
    assert st.revision_panel(df.limit(0), ["x"]).count() == 0
