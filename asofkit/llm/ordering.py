"""Global places and running sums of a table in an order that no single task holds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage


def running(df: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """The rows with `place` (0, 1, ... in the order) and `before` (the sum of `value`, a long without nulls, over the rows before).

    One range shuffle deals out the order, each task numbers and adds up its own range while it writes it, and the totals of the
    ranges before are added when the table is read: a row for each range is all that meets in one task. Rows that tie in
    the whole order stay in one range, and any of them may come first.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, total = TaskContext.get().partitionId(), 0, 0
        for rows in batches:
            after = total + np.cumsum(rows.column(value).to_numpy(zero_copy_only=False))
            before = np.concatenate([[total], after[:-1]]).astype(np.int64) if rows.num_rows else after
            own = {"__part": pa.array(np.full(rows.num_rows, part, np.int32)), "__place": pa.array(place + np.arange(rows.num_rows, dtype=np.int64)), "__before": pa.array(before)}
            yield pa.RecordBatch.from_arrays([*rows.columns, *own.values()], names=[*rows.schema.names, *own])
            if rows.num_rows:
                place, total = place + rows.num_rows, int(after[-1])

    kinds = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__place", T.LongType()), T.StructField("__before", T.LongType())])
    dealt = storage.written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, kinds), "ordered")
    per = dealt.groupBy("__part").agg(F.count("*").alias("__n"), F.sum(value).alias("__sum"))
    w = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    past = per.select("__part", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__past{c}") for c in ("__n", "__sum")))
    # a row for each range, so as many as spark.sql.shuffle.partitions at most
    both = dealt.join(F.broadcast(past), "__part")
    return both.select(*df.columns, (F.col("__place") + F.col("__past__n")).alias("place"), (F.col("__before") + F.col("__past__sum")).alias("before"))
