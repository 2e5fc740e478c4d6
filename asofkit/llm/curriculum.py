"""Mixing sources along a curriculum: weight schedules are integrated to targets, and demand is inverted to training positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering, storage

#: A schedule is knots (progress, weight) from progress 0 to 1, straight between them.
Schedule = Sequence[tuple[float, float]]
#: Sources take these in turn by code point; their integrals are 1, 2 and 3: one that fades, one that is steady, one that grows.
SCHEDULES: Sequence[Schedule] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (1.0, 4.5)))
#: No document is used more often than this.
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def segments(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(progress, width, weight at its start, weight at its end, area before) of each straight piece."""
    out, area = [], 0.0
    for (t, v), (u, w) in zip(schedule, schedule[1:], strict=False):
        if u > t:
            out.append((t, u - t, v, w, area))
            area += (u - t) * (v + w) / 2
    return out


def integral(schedule: Schedule) -> float:
    t, width, v, w, before = segments(schedule)[-1]
    return round(before + width * (v + w) / 2, 10)


def progress_at(schedule: Schedule, share: Column) -> Column:
    """The progress at which a schedule's integral reaches a share of the whole: a quadratic for each straight piece."""
    whole, out = integral(schedule), None
    for t, width, v, w, before in segments(schedule):
        inside = F.greatest(share * F.lit(whole) - F.lit(before), F.lit(0.0))
        root = F.lit(v) + F.sqrt(F.greatest(F.lit(v * v) + F.lit(2.0 * ((w - v) / width)) * inside, F.lit(0.0)))
        at = F.lit(t) + F.coalesce(F.lit(2.0) * inside / F.nullif(root, F.lit(0.0)), F.lit(0.0))
        reached = share * F.lit(whole) <= F.lit(before + width * (v + w) / 2)
        out = F.when(reached, at) if out is None else out.when(reached, at)
    return F.coalesce(out, F.lit(1.0))


def _level(sources: DataFrame) -> float:
    """Words for each unit of weight, when sources stop at their cap and the others share the excess by weight.

    Each round is one aggregate to three numbers; the sources at their cap only grow in number, so the rounds end.
    """
    total = int(sources.agg(F.coalesce(F.sum(F.col("source_size").cast("decimal(38,0)")), F.lit(0))).first()[0])
    level, held = 0.0, -1
    while True:
        full = (F.col("cap") <= F.col("weight") * F.lit(level)) if held >= 0 else F.lit(False)
        n, caps, weights = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0).cast("decimal(38,0)")), F.sum(F.when(~full, F.col("weight")).otherwise(0.0).cast("decimal(38,10)"))).first()
        if n == held or not weights:
            return level
        held, level = n, float(total - int(caps)) / float(weights)


def targets(sized: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, first, kind, target, quota) of each source of rows (source, size), a written table.

    Sources stand in order of code point, null last; `first` is the sum of the sizes of those before, `kind` the number of the
    schedule, `quota` the whole words of the target. The targets add up to all words and none exceeds `repeats` times its source.
    """
    per = ordering.running(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "source_size")
    kind = F.col("place") % len(schedules)
    weights = F.array(*(F.lit(float(integral(s))) for s in schedules))
    sources = storage.written(per.select("source", "source_size", F.col("before").alias("first"), kind.cast("int").alias("kind"), F.get(weights, kind.cast("int")).alias("weight"), (F.col("source_size") * repeats).alias("cap")), "sources")
    share = F.col("weight") * F.lit(_level(sources))
    target = F.when(F.col("cap") <= share, F.col("cap").cast("double")).otherwise(share)
    return sources.select("source", "source_size", "first", "kind", target.alias("target"), F.floor(target).cast("long").alias("quota"))


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, schedules: Sequence[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """A row per document: row, doc_id, source, size, source_size, target, kind, and `copies` as array<struct<epoch, at, words, progress>>.

    Size counts words; a null text has none. A source's documents stand in an order that the digest of their id draws (rows
    without id: of their text), epoch after epoch, and its demand takes them from the front until its quota is met; the last
    one is cut to the words that are left. `at` is where a copy starts in the source's demand and `progress` when the integral
    of its schedule gets there. Rows that repeat an id are documents of their own. No rows give no rows.
    """
    mark = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mark.alias("mark"))
    sized = storage.written(sized, "sized")
    sources = targets(sized, schedules, repeats).select(F.col("source").alias("__source"), "source_size", "first", "kind", "target", "quota")
    rows = ordering.running(sized, [F.col("source").asc_nulls_last(), F.col("mark"), F.col("doc_id"), F.col("size")], "size")
    # by the size of the written table, Spark sends the sources to all tasks or shuffles; a hot source is then split by adaptive execution
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("__source")))
    at = lambda e: F.col("before") - F.col("first") + e * F.col("source_size")
    words = lambda e: F.greatest(F.least(F.col("quota") - at(e), F.col("size")), F.lit(0))
    reached = lambda e: at(e) / F.nullif(F.col("quota"), F.lit(0))
    when = lambda e: F.coalesce(*(F.when(F.col("kind") == k, progress_at(s, reached(e))) for k, s in enumerate(schedules)))
    copy = lambda e: F.struct(F.lit(e).alias("epoch"), at(F.lit(e)).alias("at"), words(F.lit(e)).alias("words"), when(F.lit(e)).alias("progress"))
    copies = F.filter(F.array(*map(copy, range(repeats))), lambda c: c["words"] > 0)
    return rows.select(F.col("place").alias("row"), "doc_id", "source", "size", "source_size", "target", "kind", F.col("first"), copies.alias("copies"))


def training_order(documents: DataFrame) -> DataFrame:
    """A row per copy of placed() documents, range-sorted by progress: row, doc_id, source, epoch, words, progress, number, position.

    `number` counts copies and `position` is the word at which the copy starts in training. Copies that are due at the same
    time stand by source and place in its demand.
    """
    copies = documents.select("row", "doc_id", "source", "first", F.explode("copies").alias("c")).select("row", "doc_id", "source", "first", "c.*")
    out = ordering.running(copies, [F.col("progress"), F.col("first"), F.col("source").asc_nulls_last(), F.col("at")], "words")
    return out.select("row", "doc_id", "source", "epoch", "words", "progress", F.col("place").alias("number"), F.col("before").alias("position"))


def mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, schedules: Sequence[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, copies, position (of its first copy; null if it is not used).

    Documents that the mix does not use, or that have no words, take 0. Reruns give the same rows.
    """
    documents = storage.written(placed(docs, id_col, text_col, source_col, schedules, repeats), "placed")
    keys = ["row", "doc_id", "size", "source_size", "target"]
    used = training_order(documents).groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("copies"), F.min("position").alias("position"))
    some = documents.where(F.size("copies") > 0).select(*keys).join(used, "row")
    none = documents.where(F.size("copies") == 0).select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("long").alias("position"))
    return some.unionByName(none).drop("row")
