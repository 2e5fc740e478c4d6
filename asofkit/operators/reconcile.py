"""Two sources side by side: alignment, tolerance policy, and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import breach, comparison_status, pct_diff, safe_div, signed
from ..functions.windows import by, last_value


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], shared: Sequence[str] = (), suffix: str = "_r") -> DataFrame:
    """Full outer join on null-safe keys: shared columns from the left, else from the right; `side` is both, left or right."""
    other = right.select(*(F.col(c).alias(f"{c}{suffix}") for c in right.columns), F.lit(True).alias("__r"))
    both = left.withColumn("__l", F.lit(True)).join(other, [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in keys], "full")
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left").otherwise("right")
    taken = [*keys, *shared]
    rest = [c for c in left.columns if c not in taken] + [f"{c}{suffix}" for c in right.columns if c not in taken]
    return both.select(*(F.coalesce(c, f"{c}{suffix}").alias(c) for c in taken), *rest, side.alias("side"))


def outer_join(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Measures of several tables by key: one union and one aggregate, so one shuffle."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in rest))


def enriched(master: DataFrame, other: DataFrame, on: Sequence[str], cols: Sequence[str], label: str = "source") -> DataFrame:
    """Columns of another table where it has a value, else the master's; label tells which."""
    right = other.select(*on, *(F.col(c).alias(f"__{c}") for c in cols))
    both = master.join(right, list(on), "left")
    hit = F.coalesce(*(F.col(f"__{c}").cast("string") for c in cols)).isNotNull()
    return both.withColumns({**{c: F.coalesce(f"__{c}", c) for c in cols}, label: F.when(hit, "other").otherwise("master")}).drop(*(f"__{c}" for c in cols))


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], policy: DataFrame) -> DataFrame:
    """Facts (keys, metric, value) of two sources under a policy (metric, kind, tolerance, sign_rule, scale): values, differences, status."""
    return _judged(aligned(left.select(*keys, "metric", "value"), right.select(*keys, "metric", "value"), [*keys, "metric"]), policy)


def compare_sources(values: DataFrame, keys: Sequence[str], source: str, names: tuple[str, str], policy: DataFrame) -> DataFrame:
    """compare() of two sources that lie in one table (keys, metric, source, value): one aggregate and no join, so what both derive from is read once.

    Of several values of one source, key and metric the greatest counts.
    """
    own = [F.max(F.when(F.col(source) == n, F.col("value"))) for n in names]
    has = [F.bool_or(F.col(source) == n) for n in names]
    side = F.when(has[0] & has[1], "both").when(has[0], "left").otherwise("right")
    both = values.where(F.col(source).isin(*names)).groupBy(*keys, "metric").agg(own[0].alias("value"), own[1].alias("value_r"), side.alias("side"))
    return _judged(both, policy)


def _judged(both: DataFrame, policy: DataFrame) -> DataFrame:
    both = both.join(policy, "metric", "left")
    value = signed(F.col("value_r") * F.coalesce("scale", F.lit(1.0)), F.coalesce("sign_rule", F.lit("as_is")))
    both = both.withColumn("value_r", value)
    over = F.coalesce(breach("value", "value_r", F.coalesce("kind", F.lit("relative")), F.coalesce("tolerance", F.lit(0.0))), F.lit(False))
    return both.withColumns(
        {
            "abs_diff": F.abs(F.col("value") - F.col("value_r")),
            "pct_diff": pct_diff("value", "value_r"),
            "sign_mismatch": F.coalesce(F.signum("value") * F.signum("value_r") < 0, F.lit(False)),
            "breached": over,
            "status": comparison_status("value", "value_r", F.lit(False), over),
        }
    )


def report(compared: DataFrame, *by_cols: str) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s)
    return compared.groupBy(*by_cols).agg(
        F.count("*").alias("n"), F.count_if("breached").alias("breaches"), status("missing_left").alias("missing_left"), status("missing_right").alias("missing_right"),
        F.count_if("sign_mismatch").alias("sign_mismatches"), F.avg("pct_diff").alias("mean_pct"), F.max("abs_diff").alias("max_abs"),
    )


def top_breaches(compared: DataFrame, n: int, *ties: str) -> DataFrame:
    return compared.where("breached").orderBy(F.col("pct_diff").desc_nulls_last(), *ties).limit(n)


def sequence_aligned(left: DataFrame, right: DataFrame, key: str, date: str, tolerance: int, least: int = 3) -> DataFrame:
    """(key, offset, pairs): pairs the n-th rows of both sides with offset 0, 1 or -1, where every pair is within the tolerance; most pairs win, then 0, 1, -1."""
    number = F.row_number().over(by(key, order=date))
    a = left.select(key, F.col(date).alias("__a"), number.alias("__n"))
    b = right.select(key, F.col(date).alias("__b"), number.alias("__m"))
    offsets = F.explode(F.array(*map(F.lit, (0, 1, -1))))
    pairs = a.withColumn("offset", offsets).withColumn("__m", F.col("__n") + F.col("offset")).join(b, [key, "__m"])
    tried = pairs.groupBy(key, "offset").agg(F.count("*").alias("pairs"), F.max(F.abs(F.datediff("__a", "__b"))).alias("__d")).where((F.col("pairs") >= least) & (F.col("__d") <= tolerance))
    order = F.struct("pairs", F.when(F.col("offset") == 0, 2).when(F.col("offset") == 1, 1).otherwise(0))
    return tried.groupBy(key).agg(F.max_by("offset", order).alias("offset"), F.max("pairs").alias("pairs"))


def nearest_value(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], dates: Sequence[str], lookup_date: str, value: str, days: int) -> DataFrame:
    """The value on the first candidate date that has one, else the one nearest to the first date within so many days; the earlier date wins ties.

    Candidate dates are looked up by equi-joins. The nearest comes from one union, read forwards and backwards within bins of
    `days` days, to which each looked-up date comes with its neighbours; so a hot key has many bins. Of several values of one
    key and date the least counts. Rows may repeat; without key or date they find nothing.
    """
    width = max(days, 1)
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, lookup_date)))
    known = lookup.where(whole).groupBy(*keys, F.col(lookup_date).alias("__d")).agg(F.struct(F.min(value).alias("v")).alias("__v"))
    found = rows
    for k, c in enumerate(dates):
        own = known.select(*(F.col(x).alias(f"__k_{x}") for x in keys), F.col("__d").alias("__on"), F.col("__v").alias(f"__v{k}"))
        found = found.join(own, [F.col(x) == F.col(f"__k_{x}") for x in keys] + [F.col(c) == F.col("__on")], "left").drop("__on", *(f"__k_{x}" for x in keys))
    bin_of = F.floor(F.unix_date("__at") / width)
    asked = found.withColumns({"__at": F.col(dates[0]).cast("date"), "__side": F.lit(1)}).withColumn("__bin", bin_of)
    spread = known.select(*keys, F.col("__d").alias("__at"), F.lit(0).alias("__side"), F.struct(F.col("__d").alias("d"), F.col("__v").alias("v")).alias("__near")).withColumn("__bin", F.explode(F.array(*(bin_of + k for k in (-1, 0, 1)))))
    both = asked.unionByName(spread, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__bin")
    before = last_value("__near", w.orderBy("__at", "__side"))
    after = last_value("__near", w.orderBy(F.col("__at").desc(), "__side"))
    both = both.withColumns({"__before": before, "__after": after}).where("__side = 1")
    near = lambda side: F.when(F.abs(F.datediff(f"{side}.d", "__at")) <= days, F.col(side))
    both = both.withColumns({"__before": near("__before"), "__after": near("__after")})
    nearer = F.coalesce(F.datediff("__at", "__before.d") <= F.datediff("__after.d", "__at"), F.col("__before").isNotNull())
    best = F.coalesce(*(F.col(f"__v{k}") for k in range(len(dates))), F.when(nearer, F.col("__before.v")).otherwise(F.col("__after.v")))
    return both.select(*rows.columns, best["v"].alias(value))


def consensus(values: DataFrame, keys: Sequence[str], source: str, value: str, near: float = 0.05) -> DataFrame:
    """Sources, values and whether all lie within 5 % of the largest magnitude."""
    spread = F.max(value) - F.min(value) <= near * F.greatest(F.max(F.abs(value)), F.lit(1.0))
    return values.groupBy(*keys).agg(F.count_distinct(source).alias("sources"), F.count(value).alias("n"), spread.alias("agree"))


def coverage(values: DataFrame, key: str, period: str, source: str, names: Sequence[str]) -> DataFrame:
    """Per key: rows and distinct periods of each source, and the periods that all have."""
    rows = [F.count_if(F.col(source) == s).alias(f"rows_{s}") for s in names]
    periods = [F.collect_set(F.when(F.col(source) == s, F.col(period))).alias(f"__{s}") for s in names]
    out = values.groupBy(key).agg(*rows, *periods)
    common = F.col(f"__{names[0]}")
    for s in names[1:]:
        common = F.array_intersect(common, F.col(f"__{s}"))
    return out.select(key, *(f"rows_{s}" for s in names), *(F.size(f"__{s}").alias(f"periods_{s}") for s in names), F.size(common).alias("overlap"))


def clusters(covered: DataFrame, filing: str, other: str) -> DataFrame:
    """cluster: overlap (4 common periods), filing_only (4), partial (2 of any), else poor."""
    f, o = F.col(f"periods_{filing}"), F.col(f"periods_{other}")
    return covered.withColumn("cluster", F.when(F.col("overlap") >= 4, "overlap").when(f >= 4, "filing_only").when((f >= 2) | (o >= 2), "partial").otherwise("poor"))


def confidence(score_base: Column, points: Sequence[Column], cap: Column) -> Column:
    """A base and added points, capped, from 0 to 100."""
    return F.greatest(F.lit(0), F.least(sum(points, score_base), cap, F.lit(100)))


def band(score: str | Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= 90, "very_high").when(score >= 75, "high").when(score >= 50, "medium").when(score >= 25, "low").otherwise("very_low")


def recovery(rules: Sequence[tuple[Column, str, int]], otherwise: tuple[str, int]) -> Column:
    """struct(lane, priority) of the first rule that holds."""
    pair = lambda lane, priority: F.struct(F.lit(lane).alias("lane"), F.lit(priority).alias("priority"))
    out = F.when(rules[0][0], pair(*rules[0][1:]))
    for condition, lane, priority in rules[1:]:
        out = out.when(condition, pair(lane, priority))
    return out.otherwise(pair(*otherwise))


def best_match(left: DataFrame, right: DataFrame, key: str, period: str, name: str, value: str, near: float = 0.15, least: int = 3) -> DataFrame:
    """(key, name, match, score): for each left name the right one whose values agree most, over at least three common periods.

    score is the greater of the share within 15 % and of the steadiness of the ratio. The join is on key and period.
    """
    r = right.select(key, period, F.col(name).alias("match"), F.col(value).alias("__v"))
    both = left.join(r, [key, period]).withColumn("__q", safe_div("__v", value))
    within = F.avg((F.abs(F.col(value) - F.col("__v")) <= near * F.abs(value)).cast("int"))
    steady = 1 - F.least(F.lit(1.0), F.coalesce(F.stddev_pop("__q") / F.abs(F.nullif(F.avg("__q"), F.lit(0.0))), F.lit(1.0)))
    scored = both.groupBy(key, name, "match").agg(F.count("*").alias("n"), F.greatest(within, steady).alias("score")).where(F.col("n") >= least)
    w = Window.partitionBy(key, name).orderBy(F.col("score").desc(), "match")
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def hit_rates(errors: DataFrame, keys: Sequence[str], tolerances: Sequence[float], error: str = "error") -> DataFrame:
    return errors.groupBy(*keys).agg(*(F.avg((F.col(error) <= t).cast("int")).alias(f"within_{round(t * 100)}") for t in tolerances))


def best_mode(errors: DataFrame, key: str, metric: str, mode: str, error: str = "error", most: float = 0.15) -> DataFrame:
    """(key, mode): a metric votes for the mode whose median error is below half of the other's and below 15 %; most votes win."""
    medians = errors.groupBy(key, metric, mode).agg(F.percentile(error, 0.5).alias("m"))
    w = Window.partitionBy(key, metric)
    best = medians.withColumns({"__a": F.min("m").over(w), "__z": F.max("m").over(w)})
    votes = best.where((F.col("m") == F.col("__a")) & (F.col("m") < most) & (F.col("m") < F.col("__z") / 2)).groupBy(key, mode).agg(F.count("*").alias("votes"))
    return votes.groupBy(key).agg(F.max_by(mode, F.struct("votes", mode)).alias(mode), F.max("votes").alias("votes"))


def name_match(left: DataFrame, right: DataFrame, period: str, name: str, value: str, row_key: Sequence[str]) -> DataFrame:
    """Each left row's value by the same name, else the same letters and digits, else a name that holds the other (both of three letters or more).

    Two equi-joins; what is left meets the names of its period that share a trigram: the first one of the shorter
    name with all of the longer one. Of several names of one kind the least counts.
    """
    from ..functions.columns import name_key

    r = right.groupBy(period, F.col(name).alias("__name")).agg(F.max(value).alias("__v")).withColumn("__key", name_key("__name"))
    rows = left.select(*row_key, period, name).withColumn("__k", name_key(name))
    found = lambda rank: F.struct(F.lit(rank).alias("rank"), F.col("__name").alias("name"), F.col("__v").alias("v")).alias("__m")
    same = rows.join(r, (rows[period] == r[period]) & (rows[name] == r["__name"])).select(*row_key, found(0))
    alike = rows.join(r, (rows[period] == r[period]) & (rows["__k"] == r["__key"])).select(*row_key, found(1))
    first = same.unionByName(alike).groupBy(*row_key).agg(F.min("__m").alias("__m"))
    rest = rows.join(first.select(*row_key), list(row_key), "left_anti").where(F.length("__k") >= 3)
    long_enough = r.where(F.length("__key") >= 3)
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda k: F.substring(F.col(c), k, 3))))
    within = rest.withColumn("__g", grams("__k")).join(long_enough.withColumn("__g", F.substring("__key", 1, 3)), [period, "__g"]).where(F.contains("__k", F.col("__key")))
    around = rest.withColumn("__g", F.substring("__k", 1, 3)).join(long_enough.withColumn("__g", grams("__key")), [period, "__g"]).where(F.contains("__key", F.col("__k")))
    held = within.select(*row_key, found(2)).unionByName(around.select(*row_key, found(2))).groupBy(*row_key).agg(F.min("__m").alias("__m"))
    best = first.unionByName(held)
    return left.join(best, list(row_key), "left").select(*left.columns, F.col("__m.name").alias("match"), F.col("__m.v").alias("matched_value"))


def capacity_hits(rows: DataFrame, value: str, matched: str, keys: Sequence[str], tolerances: Sequence[float] = (0.05, 0.1, 0.15)) -> DataFrame:
    """How many matched values lie within each tolerance."""
    error = F.abs(F.col(value) - F.col(matched)) / F.abs(F.nullif(F.col(value), F.lit(0.0)))
    return rows.groupBy(*keys).agg(F.count(matched).alias("matched"), *(F.count_if(error <= t).alias(f"within_{round(t * 100)}") for t in tolerances))
