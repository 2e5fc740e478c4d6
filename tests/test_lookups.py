"""Compiled rules, two-sided lookups and the filing cascade against brute force."""

import datetime as dt
import random

import pytest

from asofkit.operators import facts, reconcile, rules


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def joins(df):
    """Join lines of the plan that compare by order."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if "Join" in x and (" <= " in x or " >= " in x or " < " in x)]


RULES = "priority int, code int, low int, high int, keywords string, label string"


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_in_order(spark, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abC") for _ in range(n))
    table = [(r.randrange(12), r.choice([None, r.randrange(-50, 50)]), low := r.choice([None, r.randrange(-50, 40)]), r.choice([None, (low or 0) + r.randrange(-3, 20)]), r.choice([None, "", "|", word(1) + "|" + word(4), word(2) + "|", word(7)]), f"l{k}") for k in range(25)]
    table += [(0, 2147483647, None, None, None, "last"), (0, -2147483648, None, None, None, "first")]
    rows = [(k, r.choice([None, r.randrange(-60, 60)]), r.choice([None, "", word(1), word(2), word(9), "xyz"])) for k in range(150)] + [(900, 2147483647, None), (901, -2147483648, "xyz"), (902, 7, "é"), (902, 7, "é")]
    out = rules.lookup(spark.createDataFrame([(*x, "old") for x in rows], "id int, c int, t string, code string"), spark.createDataFrame(table, RULES), "c", "t", "none")
    assert out.columns == ["id", "c", "t", "code", "label"] and joins(out) == []
    rank = lambda x: tuple((v is not None, v) if v is not None else (False, 0) for v in x)

    def fits(x, c, t):
        _, code, low, high, words, _ = x
        return c is not None and (code == c or (low is not None and high is not None and low <= c <= high)) or (t is not None and any(w and w in t.lower() for w in (words or "").lower().split("|")))

    expected = [(i, next((x[5] for x in sorted(table, key=rank) if fits(x, c, t)), "none")) for i, c, t in rows]
    assert sorted((x["id"], x["label"]) for x in out.collect()) == sorted(expected)


def test_rules_without_rows(spark):
    none = spark.createDataFrame([], RULES)
    rows = spark.createDataFrame([(1, 5, "abc")], "id int, c int, t string")
    assert rules.lookup(rows, none, "c", "t", "none").first()["label"] == "none"
    assert rules.lookup(rows.limit(0), none, "c", "t", "none").count() == 0


def test_accounts_by_pattern(spark):
    rows = [("I1", "x"), ("i", "Net  Sales!"), ("i", "total of SALES"), ("i", "a b"), (None, "costs"), ("i", None), ("i", "")]
    out = facts.canonical_accounts(spark.createDataFrame(rows, "account_id string, account_name string"), spark.createDataFrame([("I1", "one")], "id string, metric string"), spark.createDataFrame([("netsales", "net")], "name string, metric string"), spark.createDataFrame([(2, "sales", "sales"), (1, "totalof", "total"), (3, "ab", "short"), (4, "", "never")], "rank int, pattern string, metric string"))
    assert joins(out) == []
    got = {(x["account_id"], x["account_name"]): (x["metric"], x["match_priority"]) for x in out.collect()}
    assert got == {rows[0]: ("one", 0), rows[1]: ("net", 10), rows[2]: ("total", 20), rows[3]: ("short", 20), rows[4]: (None, 999), rows[5]: (None, 999), rows[6]: (None, 999)}


@pytest.mark.parametrize("days", [0, 5, 40])
def test_nearest_values(spark, days):
    r = random.Random(days)
    known = [(r.choice("ab"), day(r.randrange(300)), float(r.randrange(50))) for _ in range(60)] + [("a", None, 1.0), (None, day(5), 2.0)]
    rows = [(k, r.choice(["a", "b", "c", None]), r.choice([None, day(r.randrange(-20, 330))]), r.choice([None, day(r.randrange(300))])) for k in range(250)] + [(1000, "a", day(7), None)] * 2
    out = reconcile.nearest_value(spark.createDataFrame([(*x, 0) for x in rows], "id int, k string, one date, two date, d int"), spark.createDataFrame(known, "k string, d date, v double"), ["k"], ["one", "two"], "d", "v", days)
    assert out.columns == ["id", "k", "one", "two", "d", "v"] and joins(out) == []
    expected = []
    for i, k, one, two in rows:
        best = {}
        for x, d, v in known:
            if k is not None and x == k and d is not None:
                best[d] = min(v, best.get(d, v))
        near = min(((abs((d - one).days), d) for d in best if one and abs((d - one).days) <= days), default=None)
        expected.append((i, best[one] if one in best else best[two] if two in best else best[near[1]] if near else None))
    assert sorted(((x["id"], x["v"]) for x in out.collect()), key=str) == sorted(expected, key=str)


def test_filing_cascade(spark):
    r = random.Random(3)
    name = lambda: r.choice([None, "report", "annual report 2020.03", "notice 2020.03", "2020.06 and 12020.03", "report (2020.06)", ""])
    filings = [(r.choice("abc"), k, r.choice([None, "x", "y"]), r.choice([None, day(60), day(150)]), name(), r.choice([None, day(r.randrange(90))])) for k in range(80)]
    rows = [(k, r.choice(["a", "b", "c", "none", None]), r.choice([None, r.randrange(100)]), r.choice([None, "x", "y", "z"]), r.choice([None, day(60), day(150), day(151)])) for k in range(200)]
    out = facts.best_filing(spark.createDataFrame(rows, "id int, k string, accession int, report_code string, period_end date"), spark.createDataFrame(filings, "k string, accession int, report_code string, period_end date, name string, filing_date date"), "k", "id")
    assert joins(out) == []
    expected = []
    for i, k, acc, code, end in rows:
        scored = []
        for fk, fa, fc, fe, fn, fd in filings:
            if fk == k:
                eq = lambda a, b: a is not None and a == b
                scored.append((eq(acc, fa), eq(code, fc), eq(end, fe), "report" in (fn or ""), end is not None and end.strftime("%Y.%m") in (fn or ""), fd is not None, fd or day(0), fa, fd))
        best = max(scored, default=None)
        expected.append((i, best and best[7], best and best[8]))
    assert sorted((x["id"], x["filing"], x["filing_date"]) for x in out.collect()) == expected


def test_filing_cascade_is_dealt_by_keys(spark):
    """Values that hold a separator stay apart, and the many questions of few rows are not broadcast."""
    filings = [("a", "x\x01y", "z", None, "", day(1)), ("a", "w", "z", None, "report", day(2))]
    rows = [(1, "a", "x", "y\x01z", None), (2, "a", "x\x01y", "z", None)]
    out = facts.best_filing(spark.createDataFrame(rows, "id int, k string, accession string, report_code string, period_end date"), spark.createDataFrame(filings, "k string, accession string, report_code string, period_end date, name string, filing_date date"), "k", "id")
    assert sorted((x["id"], x["filing"]) for x in out.collect()) == [(1, "w"), (2, "x\x01y")]
    few = spark.range(1000).selectExpr("CAST(id AS int) AS id", "CAST(id % 7 AS string) AS k", "CAST(id AS string) AS accession", "CAST(id % 3 AS string) AS report_code", "DATE '2020-01-01' AS period_end")
    out = facts.best_filing(few, few.selectExpr("k", "accession", "report_code", "period_end", "'report 2020.01' AS name", "period_end AS filing_date"), "k", "id")
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert [x for x in plan if "BroadcastHashJoin" in x and "__entry" in x or "BroadcastHashJoin" in x and "__month" in x] == []
    assert out.where("filing = accession").count() == 1000
