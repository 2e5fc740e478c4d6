"""Structured Streaming: incremental loads by key, changed keys, and windows over events."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import upsert
from ..sources.store import Store


def source(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def load(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Runs all that is there through `apply` batch by batch and stops; the checkpoint makes it start after the last batch next time."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_into(path: str, keys: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """A batch function: the newest row of each key replaces the stored one.

    Each batch writes the version of its number from the one before, so a repeated batch is safe; older ones are deleted.
    """
    from ..operators.dedupe import first_per_key

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = first_per_key(batch, keys, [F.col(order).desc()])
        before = f"{path}/v={number - 1}"
        old = spark.read.parquet(before) if number else fresh.limit(0)
        upsert(old, fresh, keys).write.mode("overwrite").parquet(f"{path}/v={number}")
        if number > 1:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number - 2}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return apply


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of an upsert_into() table."""
    every = spark.read.parquet(path)
    return every.join(every.agg(F.max("v").alias("v")), "v", "left_semi").drop("v")


def maintain(store: Store, name: str, rows: str, derived: Mapping[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps tables derived from `rows` up to date when rows arrive late.

    The key groups of the batch are read from their buckets, all derived tables are computed anew for them alone, and the
    rows and what derives from them are replaced in one commit, so a group from which nothing derives any more loses its derived rows;
    buckets without a key of the batch keep their files. A batch that is repeated
    after a failure finds its number in the store and does nothing. derived: for each table a function of all rows of some key
    groups, which treats each group by itself. Equal rows count once. A new checkpoint counts from 0 again, so it needs a name of its own.
    """

    def apply(batch: DataFrame, number: int) -> None:
        known = store.rows_of(rows, batch)
        every = store.staged((batch if known is None else known.unionByName(batch, allowMissingColumns=True)).distinct(), f"{name}-{number}")
        # a table with the key of the rows has no other key groups than theirs, so it need not be computed to find them
        within = {table: every for table in derived if list(store.tables[table]) == list(store.tables[rows])}
        store.replace((name, number), {rows: every, **{table: f(every) for table, f in derived.items()}}, within=within)
        store.dropped(f"{name}-{number}")

    return apply


def changed_keys(filings: DataFrame, universe: DataFrame, key: str, keyword: str, column: str = "report") -> DataFrame:
    """Filings of the universe whose report name has a keyword: a stream against a static table."""
    return filings.where(F.contains(F.lower(column), F.lit(keyword.lower()))).join(universe.select(key).distinct(), key, "left_semi")


def stale(planned: DataFrame, checkpoints: DataFrame, keys: Sequence[str], days: int, done: str = "completed_at") -> DataFrame:
    """Planned work whose checkpoint is older than so many days or lacks."""
    fresh = checkpoints.where(F.col(done) >= F.date_sub(F.current_date(), days))
    return planned.join(fresh.select(*keys).distinct(), list(keys), "left_anti")


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first of events with one id, remembered for the watermark's delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, every: str, slide: str | None = None, time: str = "ts", delay: str = "1 hour", by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Counts and sums by tumbling or sliding window."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    w = F.window(time, every, slide) if slide else F.window(time, every)
    out = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
