"""Tables replaced together: crashes, repeated batches, untouched files, the ledger and its resume, late filings."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from asofkit.operators import statements as st
from asofkit.sources import store
from asofkit.streaming import streams


@pytest.fixture
def kept(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/store", {"totals": ["k"], "ranks": ["k", "d"]}, 4)


def frame(spark, rows, columns="k string, d int, v double"):
    return spark.createDataFrame(rows, columns)


def held(own, relation):
    df = own.read(relation)
    return [] if df is None else sorted(tuple(r) for r in df.select("k", "d", "v").collect())


START = [(k, d, float(d)) for k in "abcdef" for d in range(3)]


def names(own, relation):
    """The data files of each bucket."""
    return {b: sorted(n for n in os.listdir(f.removeprefix("file://")) if n.endswith(".parquet")) for b, f in own.files(relation).items()}


def test_key_groups_are_replaced_in_all_tables(spark, kept):
    assert held(kept, "totals") == [] and kept.files("totals") == {}
    assert kept.replace(("s", 0), {"totals": frame(spark, START), "ranks": frame(spark, START)})
    assert held(kept, "totals") == held(kept, "ranks") == START
    new = [("a", 7, 1.0), ("g", 8, 2.0)]
    assert kept.replace(("s", 1), {"totals": frame(spark, new)}, {"ranks": frame(spark, [("b", 1)], "k string, d int"), "totals": frame(spark, [("c",)], "k string")})
    assert held(kept, "totals") == sorted([r for r in START if r[0] not in "ac"] + new)
    assert held(kept, "ranks") == [r for r in START if r[:2] != ("b", 1)]


def test_a_batch_counts_once(spark, kept):
    assert kept.replace(("s", 3), {"totals": frame(spark, START)})
    for n in (3, 2):
        assert not kept.replace(("s", n), {"totals": frame(spark, [("a", 9, 9.0)])})
    assert held(kept, "totals") == START
    assert kept.replace(("other", 0), {"totals": frame(spark, [("a", 9, 9.0)])}) and ("a", 9, 9.0) in held(kept, "totals")


def test_a_crash_between_two_tables_leaves_the_old_state(spark, kept, monkeypatch):
    kept.replace(("s", 0), {"totals": frame(spark, START), "ranks": frame(spark, START)})
    new, write, done = [("a", 9, 9.0)], store.Store._write, []

    def fails(self, *args):
        if done:
            raise OSError("disk is gone")
        done.append(args[0])
        write(self, *args)

    monkeypatch.setattr(store.Store, "_write", fails)
    with pytest.raises(OSError):
        kept.replace(("s", 1), {"totals": frame(spark, new), "ranks": frame(spark, new)})
    assert done and held(kept, "totals") == held(kept, "ranks") == START
    monkeypatch.undo()
    # what the crash has left is not taken up by a commit of the same number that does not write there
    kept.replace(None, {}, {done[0]: frame(spark, [("nobody", 0)], "k string, d int")})
    assert held(kept, done[0]) == START
    assert kept.replace(("s", 1), {"totals": frame(spark, new), "ranks": frame(spark, new)})
    assert held(kept, "totals") == sorted([r for r in START if r[0] != "a"] + new) and len(held(kept, "ranks")) == len(START) + 1


def test_a_crash_before_the_manifest_leaves_the_old_state(spark, kept, monkeypatch):
    kept.replace(("s", 0), {"totals": frame(spark, START)})
    monkeypatch.setattr(store.Store, "_commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kept.replace(("s", 1), {"totals": frame(spark, [("a", 9, 9.0)])})
    assert held(kept, "totals") == START


def test_two_writers_of_one_version(spark, kept):
    kept.replace(("s", 0), {"totals": frame(spark, START)})
    with pytest.raises(RuntimeError):
        kept._commit(1, {}, {})
    assert held(kept, "totals") == START


def test_untouched_buckets_keep_their_files_and_vacuum_keeps_what_counts(spark, kept):
    kept.replace(("s", 0), {"totals": frame(spark, START)})
    before = names(kept, "totals")
    touched = frame(spark, [("a", 9, 9.0)])
    kept.replace(("s", 1), {"totals": touched})
    after = names(kept, "totals")
    bucket = touched.select(kept.bucket_of("totals")).first()[0]
    assert len(before) > 1 and {b for b in before if before[b] != after[b]} == {bucket}
    kept.vacuum()
    assert names(kept, "totals") == after and len(held(kept, "totals")) == len(START) - 2
    assert sum(len(f) for f in after.values()) == sum(n.endswith(".parquet") for _, _, f in os.walk(kept.path.removeprefix("file://") + "/data") for n in f)


def test_new_columns_and_emptied_tables(spark, kept):
    kept.replace(None, {"totals": frame(spark, START)})
    kept.replace(None, {"totals": frame(spark, [("a", 1, 1.0, "x")], "k string, d int, v double, note string")})
    assert sorted((r["k"], r["note"]) for r in kept.read("totals").collect() if r["note"]) == [("a", "x")]
    kept.replace(None, {}, {"totals": kept.read("totals")})
    assert held(kept, "totals") == []
    assert kept.replace(None, {"totals": frame(spark, [])}) and held(kept, "totals") == []


def test_windows_end_on_the_last_day():
    day = dt.date
    assert store.windows(day(2020, 1, 31), day(2020, 4, 30), 1) == [(day(2020, 1, 31), day(2020, 2, 28)), (day(2020, 2, 29), day(2020, 3, 30)), (day(2020, 3, 31), day(2020, 4, 29)), (day(2020, 4, 30), day(2020, 4, 30))]
    assert store.windows(day(2020, 1, 1), day(2021, 2, 3), 6) == [(day(2020, 1, 1), day(2020, 6, 30)), (day(2020, 7, 1), day(2020, 12, 31)), (day(2021, 1, 1), day(2021, 2, 3))]
    assert store.windows(day(2020, 1, 2), day(2020, 1, 1), 6) == []


def test_backfill_resumes(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}/store", {"lines": ["day"], "ledger": ["job", "window_start"]}, 4)
    calls, broken = [], {2, 3}

    def load(start, end):
        calls.append(start.month)
        if start.month in broken:
            bad = F.raise_error(F.lit("no source")) if start.month == 3 else None
            if bad is None:
                raise ConnectionError("no source")
            return {"lines": spark.range(3).select(F.lit(start).alias("day"), bad.cast("long").alias("n"))}
        return {"lines": spark.range(start.month).select(F.lit(start).alias("day"), F.col("id").alias("n"))}

    span = ("job", dt.date(2024, 1, 1), dt.date(2024, 4, 30), 1, load)
    state = lambda df: [(r["window_start"].month, r["status"], r["rows"], r["attempts"]) for r in df.orderBy("window_start").collect()]
    assert state(store.backfill(own, *span)) == [(1, "completed", 1, 1), (2, "failed", None, 1), (3, "failed", None, 1), (4, "completed", 4, 1)]
    assert "no source" in own.read("ledger").where("status = 'failed'").first()["note"] and own.read("lines").count() == 5
    own.replace(None, {"ledger": spark.createDataFrame([("job", dt.date(2024, 4, 1), dt.date(2024, 4, 30), "running", None, 1, None)], store.LEDGER)})  # interrupted
    broken.clear()
    calls.clear()
    assert state(store.backfill(own, *span)) == [(1, "completed", 1, 1), (2, "completed", 2, 2), (3, "completed", 3, 2), (4, "completed", 4, 2)]
    assert calls == [2, 3, 4] and own.read("lines").count() == 10
    assert store.backfill(own, "other", dt.date(2024, 1, 2), dt.date(2024, 1, 1), 1, load).count() == 0


def test_late_filings_change_their_own_tickers_only(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}/store", {"filings": ["ticker"], "panel": ["ticker"]}, 8)
    day = lambda n: dt.date(2023, 1, 1) + dt.timedelta(days=n)
    columns = "ticker string, period_end date, available_date date, filing_date date, version int, x double"
    first = [(t, day(91 * q), day(91 * q + 40), day(91 * q + 40), 1, float(q)) for t in "abcdefgh" for q in range(6)]
    late = [("a", day(91), day(700), day(700), 2, 50.0), ("a", day(91 * 5), day(710), day(710), 2, 60.0)]
    keep = streams.maintain(own, "s", "filings", {"panel": lambda df: st.revision_panel(df, ["x"])})
    keep(spark.createDataFrame(first, columns), 0)
    before = names(own, "panel")
    late_rows = spark.createDataFrame(late, columns)
    keep(late_rows, 1)
    keep(late_rows, 1)  # the stream runs a batch again after a failure
    after = names(own, "panel")
    bucket = late_rows.select(own.bucket_of("panel")).first()[0]
    assert {b for b in before if before[b] != after[b]} == {bucket}
    every = st.revision_panel(spark.createDataFrame(first + late, columns), ["x"])
    assert sorted(map(tuple, own.read("panel").select(every.columns).collect()), key=str) == sorted(map(tuple, every.collect()), key=str)
    assert own.read("filings").count() == len(first) + len(late)


def test_derived_tables_are_computed_once(spark, tmp_path):
    """A batch runs each derived function once over its rows, and a group from which nothing derives any more has no derived rows."""
    own, seen = store.Store(spark, str(tmp_path), {"rows": ["k"], "kept": ["k"]}, 4), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    keep = streams.maintain(own, "s", "rows", {"kept": lambda df: df.groupBy("k").agg(F.sum("x").alias("x")).where("x > 0").mapInArrow(counted, "k string, x long")})
    keep(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, x long"), 0)
    assert seen.value == 3
    keep(spark.createDataFrame([("a", -5), ("b", 4)], "k string, x long"), 1)
    assert seen.value == 4 and sorted(map(tuple, own.read("kept").select("k", "x").collect())) == [("b", 6), ("c", 3)]
