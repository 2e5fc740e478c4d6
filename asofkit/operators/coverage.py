"""What each source covers of an issuer: counts, clusters, reasons, value pools, and distributions over all issuers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ladder
from ..functions.windows import last_value

#: Segment types that are counted by name; all others are `other`.
TYPES = ("business", "geography", "product")


def issuer_counts(rows: DataFrame, key: str = "ticker", filing: str = "filing", second: str = "companyfacts", metrics: Sequence[str] = ("revenue", "operating_income")) -> DataFrame:
    """Per issuer: rows and periods of each family, common periods, filing periods of two metrics, filing sources, and filing rows of each segment type.

    rows: (key, period_end, family, source, metric, segment_type). Two aggregations, neither of which gathers periods in a list.
    """
    own, other = F.col("family") == filing, F.col("family") == second
    kind = F.when(F.col("segment_type").isin(*TYPES), F.col("segment_type")).otherwise("other")
    of = lambda c: F.max(c.cast("int"))
    periods = rows.groupBy(key, "period_end").agg(
        F.count_if(own).alias("f"), F.count_if(other).alias("s"), *(of(own & (F.col("metric") == m)).alias(f"m{k}") for k, m in enumerate(metrics)),
        *(F.count_if(own & (kind == t)).alias(f"t_{t}") for t in (*TYPES, "other")),
    )
    sources = rows.where(own).groupBy(key).agg(F.count_distinct("source").alias("filing_sources"))
    out = periods.groupBy(key).agg(
        F.sum("f").alias("filing_rows"), F.sum("s").alias(f"{second}_rows"), F.count_if(F.col("f") > 0).alias("filing_periods"), F.count_if(F.col("s") > 0).alias(f"{second}_periods"),
        F.count_if((F.col("f") > 0) & (F.col("s") > 0)).alias("overlap_periods"), *(F.count_if(F.col(f"m{k}") > 0).alias(f"filing_{m}_periods") for k, m in enumerate(metrics)), *(F.sum(f"t_{t}").alias(f"{t}_rows") for t in (*TYPES, "other")),
    )
    return out.join(sources, key, "left").withColumn("filing_sources", F.coalesce("filing_sources", F.lit(0)))


def with_clusters(counts: DataFrame, filing: str = "filing", second: str = "companyfacts", metrics: Sequence[str] = ("revenue", "operating_income")) -> DataFrame:
    """source_cluster, metric_cluster, segment_profile and issuer_cluster of issuer_counts()."""
    f, s = F.col(f"{filing}_rows"), F.col(f"{second}_rows")
    periods, main, next_ = F.col(f"{filing}_periods"), F.col(f"{filing}_{metrics[0]}_periods"), F.col(f"{filing}_{metrics[1]}_periods")
    source = ladder([((s > 0) & (f > 0) & (F.col("overlap_periods") > 0), f"{second}_overlap"), ((f > 0) & (s == 0) & (periods >= 4), "filing_only"), ((f > 0) & (s == 0) & (periods >= 2), "filing_only_partial")], "segment_source_poor")
    metric = ladder([((main >= 4) & (next_ >= 2), f"{metrics[0]}_and_{metrics[1]}"), ((main >= 2) & (next_ == 0), f"{metrics[0]}_only"), (main >= 2, f"{metrics[0]}_primary")], "metric_sparse")
    types = [F.col(f"{t}_rows") for t in (*TYPES, "other")]
    total, most = sum(types[1:], types[0]), F.greatest(*types)
    name = F.coalesce(*(F.when(c == most, F.lit(f"{t}_dominant")) for t, c in zip((*TYPES, "other"), types, strict=True)))
    profile = F.when(total <= 0, "none").when(most / total >= 0.6, name).otherwise("mixed")
    out = counts.withColumns({"source_cluster": source, "metric_cluster": metric, "segment_profile": profile})
    issuer = F.when((F.col("source_cluster") == "filing_only") & (F.col("metric_cluster") == f"{metrics[0]}_only"), f"filing_only_{metrics[0]}_only").when(F.col("source_cluster") == "filing_only", "filing_only_full").otherwise(F.col("source_cluster"))
    return out.withColumn("issuer_cluster", issuer)


def with_poor_reason(clustered: DataFrame, log: DataFrame, meta: DataFrame, key: str = "ticker") -> DataFrame:
    """source_poor_reason, poor_reason_detail (the least five distinct reasons of the log) and parser_candidate of issuers without filing rows in the poor cluster, else null.

    log: (key, reason, method, status), meta: a row for each filing of a key.
    """
    holds = lambda *words: F.coalesce(F.bool_or(_any("reason", words)), F.lit(False))
    html = (F.col("method") == "html_table_mvp") & F.contains(F.lower("status"), F.lit("success"))
    least = log.where(F.col("reason").isNotNull()).select(key, "reason").distinct()
    least = least.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("reason"))).where("__n <= 5").groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("reason")), "|").alias("__detail"))
    found = log.groupBy(key).agg(
        holds("FileNotFoundError").alias("__cache"), holds("instance_doc_not_found_in_index", "instance_fetch_or_parse_failed").alias("__instance"), F.coalesce(F.bool_or(html), F.lit(False)).alias("__html"),
        holds("fetch_failed").alias("__fetch"), holds("segment_not_found").alias("__segment"),
    )
    filed = meta.groupBy(key).agg(F.count("*").alias("__meta"))
    out = clustered.join(found, key, "left").join(least, key, "left").join(filed, key, "left")
    poor = (F.col("issuer_cluster") == "segment_source_poor") & (F.col("filing_rows") == 0)
    is_ = lambda c: F.coalesce(c, F.lit(False))
    there = F.coalesce(F.col("__meta") > 0, F.lit(False)) | F.col("__cache").isNotNull()
    reason = ladder([(is_("__cache"), "filing_cache_missing"), (is_("__instance"), "filing_present_but_xbrl_instance_missing"), (is_("__html"), "html_only_low_confidence_candidate"), (is_("__fetch"), "filing_cache_incomplete"), (is_("__segment"), "filing_present_but_segment_not_disclosed"), (there, "parser_candidate_but_not_materialized")], "source_unavailable")
    out = out.withColumn("source_poor_reason", F.when(poor, reason))
    r = F.col("source_poor_reason")
    empty = F.when(r == "html_only_low_confidence_candidate", "html_only_candidate").when(r == "parser_candidate_but_not_materialized", "filings_present_without_segment_rows").when(r == "source_unavailable", "no_filing_meta_or_segment_logs")
    detail = F.when(r == "source_unavailable", empty).otherwise(F.coalesce("__detail", empty))
    return out.withColumns({"poor_reason_detail": F.when(poor, detail), "parser_candidate": F.coalesce(r == "parser_candidate_but_not_materialized", F.lit(False))}).select(*clustered.columns, "source_poor_reason", "poor_reason_detail", "parser_candidate")


def _any(c: str, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.col(c), F.lit(w))
    return out


def reason_codes(filing: str = "filing", second: str = "companyfacts", metrics: Sequence[str] = ("revenue", "operating_income")) -> Column:
    """The codes that hold for a row of with_clusters() and with_poor_reason(), in order."""
    f, s = F.col(f"{filing}_rows"), F.col(f"{second}_rows")
    codes = [
        F.when((s == 0) & (f > 0), f"{second}_missing_filing_present"), F.when((F.col("overlap_periods") <= 0) & (s > 0) & (f > 0), f"no_{second}_filing_overlap"),
        F.when((F.col(f"{filing}_{metrics[0]}_periods") > 0) & (F.col(f"{filing}_{metrics[1]}_periods") == 0), f"{metrics[1]}_sparse"), F.when((F.col("filing_sources") <= 1) & (f > 0), "single_filing_source"),
        F.when(F.endswith("segment_profile", F.lit("_dominant")), F.concat(F.lit("segment_type_"), "segment_profile")), F.concat(F.lit("source_poor_"), "source_poor_reason"), F.when((s == 0) & (f == 0), "segment_source_missing"),
    ]
    return F.array_compact(F.array(*codes))


def distributions(survey: DataFrame, dimensions: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """(dimension, value, n, rate): how many rows have each value of some columns, and each entry of some lists; nulls do not count. One pass."""
    one = [F.array(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))) for c in dimensions]
    many = [F.coalesce(F.transform(F.array_distinct(c), _entry(c)), F.array()) for c in lists]
    found = survey.select(F.explode(F.concat(*one, *many)).alias("e")).select("e.*").where("value IS NOT NULL").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return found.join(survey.agg(F.count("*").alias("__all"))).select("dimension", "value", "n", (F.col("n") / F.col("__all")).alias("rate"))


def _entry(c: str):
    return lambda x: F.struct(F.lit(c).alias("dimension"), x.cast("string").alias("value"))


def support(survey: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, total, issuers): the sum of each count column, and the rows in which it is above 0."""
    sums = survey.agg(*(F.struct(F.lit(c).alias("name"), F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("total"), F.count_if(F.col(c) > 0).alias("issuers")).alias(c) for c in columns))
    return sums.select(F.explode(F.array(*columns)).alias("e")).select("e.*")


def similar_values(rows: DataFrame, pool: DataFrame, keys: Sequence[str], value: str, tolerance: float, name: str = "similar") -> DataFrame:
    """Whether the pool has a value of the row's key within the tolerance (2 % at least) of the larger magnitude of both, which counts as 1 at least.

    The gap to a value grows faster than what is allowed, so only the nearest value on either side can do: one union and a window in
    the order of values. A row without value has none; null keys are equal to each other, as in a pool by key.
    """
    near = max(tolerance, 0.02)
    held = pool.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__at"), F.col(value).alias("__value"), F.lit(0).alias("__side")).distinct()
    both = rows.withColumns({"__at": F.col(value), "__side": F.lit(1)}).unionByName(held, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    both = both.withColumns({"__below": last_value("__value", w.orderBy("__at", "__side")), "__above": last_value("__value", w.orderBy(F.col("__at").desc(), "__side"))})
    close = lambda c: F.coalesce(F.abs(F.col(c) - F.col(value)) <= F.greatest(F.abs(c), F.abs(value), F.lit(1.0)) * near, F.lit(False))
    found = F.coalesce((close("__below") | close("__above")) & F.col(value).isNotNull(), F.lit(False))
    return both.where("__side = 1").withColumn(name, found).select(*rows.columns, name)


def recovery_rows(survey: DataFrame, key: str, score: str, rules: Column) -> DataFrame:
    """(key, issuer_cluster, source_poor_reason, lane, priority, score, priority_rank): what to try for each issuer, best scores first within each lane; rules: a struct(lane, priority)."""
    out = survey.select(key, "issuer_cluster", "source_poor_reason", rules.alias("__r"), F.col(score).alias("score"))
    w = Window.partitionBy("__r.lane").orderBy(F.col("score").desc(), key)
    return out.withColumn("priority_rank", F.row_number().over(w)).select(key, "issuer_cluster", "source_poor_reason", "__r.lane", "__r.priority", "score", "priority_rank")


def recovery_summary(rows: DataFrame) -> DataFrame:
    """(lane, priority, reason, n, mean_score, most): issuers of each lane and reason."""
    return rows.groupBy("lane", "priority", F.col("source_poor_reason").alias("reason")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("most"))
