"""Scans with declared projection and filters, and idempotent sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longer lists of keys are joined instead of being written into the plan.
LONGEST_LIST = 500

_OPS = {"==": "__eq__", "!=": "__ne__", ">=": "__ge__", "<=": "__le__", ">": "__gt__", "<": "__lt__"}


def condition(column: str, op: str, value: object) -> Column:
    if op == "in":
        return F.col(column).isin(*value)
    return getattr(F.col(column), _OPS[op])(value)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, filters: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
    """Projection (unknown columns are dropped) and AND-ed filters, both of which reach the Parquet scan."""
    df = spark.read.parquet(path)
    if filters:
        df = df.where(reduce(lambda a, b: a & b, (condition(*f) for f in filters)))
    return df if columns is None else df.select(*(c for c in columns if c in df.columns))


def read_partitioned(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A directory of key=value folders; keys keep their text, so that 005930 stays a string. schema: the types of all columns, read as they are given."""
    reader = spark.read.option("mergeSchema", "true")
    if schema:
        return reader.schema(schema).parquet(path)
    found = reader.parquet(path)
    keys = {k for file in found.inputFiles()[:1] for k in re.findall(r"/([^/=]+)=", file)}
    if not keys:
        return found
    typed = T.StructType([T.StructField(f.name, T.StringType() if f.name in keys else f.dataType, f.nullable) for f in found.schema])
    return spark.read.schema(typed).parquet(path)


def read_keys(df: DataFrame, key: str, keys: Sequence[object]) -> DataFrame:
    """Rows of a list of keys; a long list becomes a semi-join."""
    if len(keys) <= LONGEST_LIST:
        return df.where(F.col(key).isin(*keys))
    listed = df.sparkSession.createDataFrame([(k,) for k in keys], [key])
    return df.join(listed, key, "left_semi")


def bulk_prices(df: DataFrame, keys: Sequence[object], first: str, last: str, columns: Sequence[str] = ("ticker", "date", "close")) -> DataFrame:
    return read_keys(df, "ticker", keys).where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(*columns)


def bulk_financials(df: DataFrame, keys: Sequence[object], dates: Sequence[str] = ("period_end", "filing_date"), market: str | None = None, columns: Sequence[str] | None = None, order: Sequence[str] = ("ticker", "period_end")) -> DataFrame:
    """Statements of a list of keys (and a market), dates cast, null where they are none, in order within partitions."""
    out = read_keys(df, "ticker", keys)
    out = out if market is None else out.where(F.col("market") == market)
    out = out.withColumns({d: F.col(d).try_cast("date") for d in dates if d in out.columns})
    return (out if columns is None else out.select(*columns)).sortWithinPartitions(*order)


def filtered_scan(df: DataFrame, columns: Sequence[str], date: str | None = None, first: str | None = None, last: str | None = None, **equal: object) -> DataFrame:
    """A scan of one table: equal values, a closed date range, and the columns that exist."""
    out = df.where(reduce(lambda a, b: a & b, (F.col(c) == v for c, v in equal.items()))) if equal else df
    out = out if first is None else out.where(F.col(date) >= F.lit(first).cast("date"))
    out = out if last is None else out.where(F.col(date) <= F.lit(last).cast("date"))
    return out.select(*(c for c in columns if c in out.columns))


def chunk_scan(df: DataFrame, date: str, first: str, last: str, where: str, casts: Mapping[str, str], events: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One window of an external relation: fixed filters, casts, and the columns of its key's last event at or after the window's start, if any."""
    rows = df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).where(where)
    rows = rows.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})
    latest = events.where(F.col("event_date") >= F.lit(first).cast("date")).groupBy(key).agg(F.max_by(F.struct("event_date", *columns), F.struct("event_date", *columns)).alias("__e"))
    return rows.join(latest, key, "left").select(*rows.columns, "__e.event_date", *(f"__e.{c}" for c in columns))


def read_files(spark: SparkSession, path: str, kind: str, casts: Mapping[str, str], sort: Sequence[str] = ()) -> DataFrame:
    """Many CSV or Parquet files with drifting columns as one typed table; bad values are null."""
    if kind == "csv":
        df = spark.read.option("header", "true").option("enforceSchema", "false").csv(path)
    else:
        df = spark.read.option("mergeSchema", "true").parquet(path)
    typed = df.select(*(F.expr(f"try_cast(`{c}` AS {t})").alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in casts.items()))
    return typed.sortWithinPartitions(*sort) if sort else typed


def views(spark: SparkSession, tables: Mapping[str, DataFrame], pad: str | None = None, width: int = 6) -> None:
    """Registers temporary views; `pad` names a key that is filled up with zeros."""
    for name, df in tables.items():
        if pad and pad in df.columns:
            df = df.withColumn(pad, F.lpad(F.col(pad).cast("string"), width, "0"))
        df.createOrReplaceTempView(name)


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, position) of a symbol list with or without a header: upper case, first occurrence."""
    rows = spark.read.text(path).select(F.upper(F.trim(F.element_at(F.split("value", ","), 1))).alias("ticker"), F.monotonically_increasing_id().alias("position"))
    return rows.where(~F.col("ticker").isin("", "TICKER", "SYMBOL")).groupBy("ticker").agg(F.min("position").alias("position"))


COMPANY_FACTS = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<`start`:string,`end`:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>>>>>>>"


def company_facts(documents: DataFrame, json: str = "json", key: str = "ticker", units: Sequence[str] = ("USD", "shares", "USD/shares")) -> DataFrame:
    """Nested facts documents to rows (key, concept, unit, period_start, period_end, value, form, filed, accession); rows without an end go."""
    parsed = documents.select(key, F.from_json(json, COMPANY_FACTS).alias("d"))
    concepts = parsed.select(key, F.explode("d.facts").alias("space", "concepts")).select(key, F.explode("concepts").alias("concept", "body"))
    records = concepts.select(key, "concept", F.explode("body.units").alias("unit", "rows")).where(F.col("unit").isin(*units)).select(key, "concept", "unit", F.explode("rows").alias("r"))
    day = lambda c: F.col(f"r.{c}").try_cast("date")
    return records.select(key, "concept", "unit", day("start").alias("period_start"), day("end").alias("period_end"), F.col("r.val").alias("value"), F.col("r.form").alias("form"), day("filed").alias("filed"), F.col("r.accn").alias("accession")).where("period_end IS NOT NULL")


def transposed(df: DataFrame, metric: str, dates: Sequence[str]) -> DataFrame:
    """Metric rows by date columns to a row per date."""
    long = df.unpivot([metric], list(dates), "date", "value")
    return long.groupBy(F.to_date("date").alias("date")).pivot(metric).agg(F.first("value"))


# sinks


def replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Rewrites only the partitions that the rows touch."""
    df.repartition(*partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_newest(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-replace by key: the new row wins; of several rows of one side the one with the largest other columns."""
    both = old.withColumn("__b", F.lit(0)).unionByName(new.withColumn("__b", F.lit(1)), allowMissingColumns=True)
    rest = [c for c, t in both.dtypes if c not in (*keys, "__b") and not t.startswith("map")]
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in ("__b", *rest)))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__b")


def nested(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """A row per key with an array per column, all in the order of `order`."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    out = df.groupBy(key).agg(rows.alias("r"))
    return out.select(key, F.col(f"r.{order}").alias(order), *(F.col(f"r.{c}").alias(c) for c in columns))


def flat(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The rows of nested()."""
    return df.select(key, F.explode(F.arrays_zip(order, *columns)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in (order, *columns)))


def export_json(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)


def audited(df: DataFrame, relation: str, run: str) -> DataFrame:
    return df.withColumns({"source_relation": F.lit(relation), "run_id": F.lit(run), "collected_at": F.current_timestamp()})


def with_optional(df: DataFrame, columns: Sequence[str], optional: Mapping[str, str]) -> DataFrame:
    """Columns that must be there, and optional ones as typed nulls where the table lacks them."""
    return df.select(*columns, *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()))


def document_flags(documents: DataFrame, key: str = "ticker") -> DataFrame:
    """has_prices, has_financials, latest positive market cap and number of periods of nested documents with `prices` and `financials`."""
    caps = F.filter("prices.market_cap", lambda x: x > 0)
    return documents.select(key, (F.coalesce(F.size("prices.date"), F.lit(0)) > 0).alias("has_prices"), (F.coalesce(F.size("financials.periods"), F.lit(0)) > 0).alias("has_financials"), F.try_element_at(caps, F.lit(-1)).alias("market_cap"), F.greatest(F.coalesce(F.size("financials.periods"), F.lit(0)), F.lit(0)).alias("n_periods"))


def report_files(frames: Mapping[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Each frame below its own name."""
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        writer.option("header", "true").csv(f"{path}/{name}") if kind == "csv" else writer.parquet(f"{path}/{name}")
