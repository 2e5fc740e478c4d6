"""Raw facts to statements: picks by duration, fiscal labels, account names, units, and best filings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rules
from ..functions.columns import ladder, null_sum, reconcile_signed, safe_div
from ..functions.windows import by


def quarter_facts(facts: DataFrame, keys: Sequence[str], value: str = "value", start: str = "period_start", end: str = "period_end", filed: str = "filed") -> DataFrame:
    """(keys, period_end, value, how): a fact of 70 to 130 days as it is, else the difference to the shorter fact with the same start.

    Of several direct facts the first filed wins; a difference needs 70 to 130 days between both ends.
    """
    days = F.datediff(end, start)
    rows = facts.where(F.col(start).isNotNull() & F.col(value).isNotNull()).withColumn("__days", days)
    one = Window.partitionBy(*keys, start, end).orderBy(F.col(filed).asc_nulls_last(), value)
    rows = rows.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    chain = by(*keys, start, order=end)
    gap = F.datediff(F.col(end), F.lag(end).over(chain))
    direct = F.col("__days").between(70, 130)
    rows = rows.withColumns({"__v": F.when(direct, F.col(value)).when(gap.between(70, 130), F.col(value) - F.lag(value).over(chain)), "how": F.when(direct, "direct").otherwise("difference")})
    best = Window.partitionBy(*keys, end).orderBy(F.when(direct, 0).otherwise(1), F.col(filed).asc_nulls_last(), start)
    picked = rows.where("__v IS NOT NULL").withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return picked.select(*keys, end, F.col("__v").alias(value), "how")


def quarters_from_facts(facts: DataFrame, keys: Sequence[str], rank: Sequence[Column | str] = (), value: str = "value", start: str = "period_start", end: str = "period_end", filed: str = "filed", keep: float = 0.85) -> DataFrame:
    """(keys, period_end, value, how): quarters of flows by all rules of the filings.

    direct: the best fact of 70 to 130 days, by `rank`, then the last filed, then the larger. difference: the chain of facts with one start, if it has
    three ends or more and a fact of 131 to 320 days; each end less the one before. Where the best fact of an end
    falls below 0.85 of the total before, the best one that does not stands in. The first end counts only if it is a quarter. Of
    chains with several starts the latest start wins, and a direct fact wins over all.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in rank]
    days = F.datediff(end, start)
    rows = facts.where(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(value).isNotNull()).withColumn("__days", days)
    best = Window.partitionBy(*keys, end).orderBy(*order, F.col(filed).desc_nulls_last(), F.col(value).desc())
    direct = rows.where("__days BETWEEN 70 AND 130").withColumn("__n", F.row_number().over(best)).where("__n = 1").select(*keys, end, F.col(value).alias("__v"), F.lit(0).alias("__how"), F.lit(None).cast("date").alias("__s"))
    # the facts of one end, the best first; an end has a handful
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, start, end).orderBy(*order, F.col(filed).desc_nulls_last(), F.col(value).desc())))
    ends = numbered.groupBy(*keys, start, end).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", value))), lambda x: x[value]).alias("__c"), F.first("__days").alias("__days"))
    chains = ends.groupBy(*keys, start).agg(F.sort_array(F.collect_list(F.struct(end, "__days", "__c"))).alias("__e")).where((F.size("__e") >= 3) & F.exists("__e", lambda e: e["__days"].between(131, 320)))
    none = F.struct(F.lit(None).cast("double").alias("total"), F.array().cast(f"array<struct<`{end}`:date,`__v`:double>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        first = F.element_at(e["__c"], 1)
        falls = F.coalesce(first < keep * acc["total"], F.lit(False))
        picked = F.when(falls, F.coalesce(F.try_element_at(F.filter(e["__c"], lambda x: x >= keep * acc["total"]), F.lit(1)), first)).otherwise(first)
        own = F.when(acc["total"].isNull(), F.when(e["__days"].between(70, 130), picked)).otherwise(picked - acc["total"])
        return F.struct(picked.alias("total"), F.concat(acc["out"], F.array(F.struct(e[end].alias(end), own.alias("__v")))).alias("out"))

    steps = chains.select(*keys, F.col(start).alias("__s"), F.explode(F.aggregate("__e", none, step)["out"]).alias("o"))
    derived = steps.where("o.__v IS NOT NULL").select(*keys, F.col(f"o.{end}").alias(end), F.col("o.__v").alias("__v"), F.lit(1).alias("__how"), "__s")
    pick = Window.partitionBy(*keys, end).orderBy("__how", F.col("__s").desc())
    out = direct.unionByName(derived).withColumn("__n", F.row_number().over(pick)).where("__n = 1")
    return out.select(*keys, end, F.col("__v").alias(value), F.when(F.col("__how") == 0, "direct").otherwise("difference").alias("how"))


def filing_events(raw: DataFrame, keys: Sequence[str], end: str = "period_end", form: str = "form", filed: str = "filed", accepted: str = "accepted", accession: str = "accession") -> tuple[DataFrame, DataFrame]:
    """Distinct filings of each period (events), and the last of them with amendment and late-notice flags over all (latest).

    Events are ordered by filing date, acceptance and accession; notices of late filing (NT forms) count for the flags alone.
    """
    from ..functions.columns import form_flags

    events = raw.where(F.col(end).isNotNull()).select(*keys, end, form, filed, accepted, accession).distinct()
    order = F.struct(filed, accepted, accession, form)
    flags = form_flags(form)
    own = events.withColumns({"is_amendment": F.coalesce(flags["is_amendment"], F.lit(False)), "is_nt": F.coalesce(flags["is_nt"], F.lit(False))})
    latest = own.groupBy(*keys, end).agg(F.max_by(F.struct(form, filed, accepted, accession), F.when(~F.col("is_nt"), order)).alias("e"), F.count("*").alias("n_events"), F.bool_or("is_amendment").alias("is_amendment"), F.bool_or("is_nt").alias("is_nt"))
    return events, latest.select(*keys, end, *(F.col(f"e.{c}").alias(c) for c in (form, filed, accepted, accession)), "n_events", "is_amendment", "is_nt")


def anchored_quarters(periods: DataFrame, key: str = "ticker", end: str = "period_end", annual: str = "is_annual", most_days: int = 380) -> DataFrame:
    """fiscal_year, fiscal_quarter, anchored and shifted: periods numbered from their annual ends.

    The last four ends of a cycle (after the annual end before, at most so many days before its own) are numbered backwards
    from Q4; up to three ends after the last annual end forwards from Q1. A year that ends from January to the seventh of June bears the year before. Other rows keep their labels.
    """
    w = by(key, order=end)
    rows = periods.withColumns({
        "__next": F.first(F.when(F.col(annual), F.col(end)), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        "__last": F.last(F.when(F.col(annual), F.col(end)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    back = F.row_number().over(Window.partitionBy(key, "__next").orderBy(F.col(end).desc()))
    ahead = F.row_number().over(Window.partitionBy(key, "__last", F.col("__next").isNull()).orderBy(end))
    early = lambda d: (F.month(d) <= 5) | ((F.month(d) == 6) & (F.dayofmonth(d) <= 7))
    year = lambda d: F.year(d) - F.when(early(d), 1).otherwise(0)
    closed = F.col("__next").isNotNull() & (F.datediff("__next", end) <= most_days) & (F.col("__b") <= 4)
    open_ = F.col("__next").isNull() & F.col("__last").isNotNull() & (F.datediff(end, "__last") <= most_days) & (F.col("__a") <= 3)
    rows = rows.withColumns({"__b": back, "__a": ahead}).withColumns({
        "__y": F.when(closed, year("__next")).when(open_, year("__last") + 1), "__q": F.when(closed, 5 - F.col("__b")).when(open_, F.col("__a")),
    })
    kept = [c for c in periods.columns if c not in ("fiscal_year", "fiscal_quarter")]
    return rows.select(*kept, F.coalesce("__y", "fiscal_year").alias("fiscal_year"), F.coalesce("__q", "fiscal_quarter").alias("fiscal_quarter"), F.col("__y").isNotNull().alias("anchored"), F.coalesce((F.col("__y") != F.col("fiscal_year")) | (F.col("__q") != F.col("fiscal_quarter")), F.lit(False)).alias("shifted"))


def balance_facts(facts: DataFrame, keys: Sequence[str], order: Sequence[Column | str], end: str = "period_end") -> DataFrame:
    """The best instant fact of each period by order."""
    w = Window.partitionBy(*keys, end).orderBy(*order)
    return facts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def two_hypotheses(df: DataFrame, value: str, key: str = "ticker") -> DataFrame:
    """(key, fiscal_year, q1..q4, mode): quarters of a year whose rows are either quarters or running totals.

    Each reading pays for negative quarters and for a fourth quarter of more than three times the largest other one; the
    cheaper reading stands, the direct one on a tie.
    """
    q = lambda k: F.max(F.when(F.col("fiscal_quarter") == k, F.col(value)))
    years = df.groupBy(key, "fiscal_year").agg(*(q(k).alias(f"__{k}") for k in (1, 2, 3, 4)))
    v = [F.col(f"__{k}") for k in (1, 2, 3, 4)]
    # direct: the last row is the year where it exceeds the sum of the three before, else a quarter
    three = null_sum(*v[:3])
    direct = [*v[:3], F.when(v[3] > three, v[3] - three).otherwise(v[3])]
    running = [v[0], v[1] - v[0], v[2] - v[1], v[3] - v[2]]

    def penalty(parts: Sequence[Column]) -> Column:
        negative = sum((F.coalesce((p < 0).cast("int"), F.lit(0)) for p in parts[1:]), F.coalesce((parts[0] < 0).cast("int"), F.lit(0)))
        last = F.coalesce((F.abs(parts[3]) > 3 * F.greatest(*(F.abs(p) for p in parts[:3]))).cast("int"), F.lit(0))
        return negative + last

    mode = F.when(penalty(running) < penalty(direct), "running").otherwise("direct")
    out = years.withColumn("mode", mode)
    return out.select(key, "fiscal_year", *(F.when(F.col("mode") == "running", r).otherwise(d).alias(f"q{k}") for k, (d, r) in enumerate(zip(direct, running, strict=True), 1)), "mode")


def fiscal_labels(periods: DataFrame, key: str = "ticker", end: str = "period_end", annual: str = "is_annual") -> DataFrame:
    """fiscal_year and fiscal_quarter: annual ends are fourth quarters; others count the quarters to the next annual end, else from the last, else the calendar's."""
    w = by(key, order=end)
    following = F.first(F.when(F.col(annual), F.col(end)), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(F.when(F.col(annual), F.col(end)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = periods.withColumns({"__next": following, "__last": before})
    ahead = F.round(F.datediff("__next", end) / 91.0).cast("int")
    past = F.round(F.datediff(end, "__last") / 91.0).cast("int")
    key_ahead = F.year("__next") * 4 + 4 - ahead
    key_past = F.year("__last") * 4 + 4 + past
    number = F.coalesce(key_ahead, key_past, F.year(end) * 4 + F.quarter(end))
    return rows.withColumns({"fiscal_year": F.floor((number - 1) / 4).cast("int"), "fiscal_quarter": (F.pmod(number - 1, F.lit(4)) + 1).cast("int")}).drop("__next", "__last")


def canonical_accounts(rows: DataFrame, ids: DataFrame, names: DataFrame, patterns: DataFrame, account_id: str = "account_id", account_name: str = "account_name") -> DataFrame:
    """metric and match_priority: by exact id (0), normalised name (10), or pattern within the name (20); else null and 999.

    ids(id, metric), names(name, metric), patterns(pattern, metric, rank): all three are equi-joined, patterns by an index of their first letters.
    An empty pattern is in no name.
    """
    norm = F.regexp_replace(F.lower(account_name), r"[\s\p{Punct}]+", "")
    out = rows.withColumn("__norm", norm)
    first = rules.first_contained(out, "__norm", patterns.select("pattern", F.struct("rank", "pattern", "metric").alias("__p")), "pattern", "__p")
    out = out.join(ids.select(F.col("id").alias(account_id), F.col("metric").alias("__id")), account_id, "left")
    out = out.join(names.select(F.col("name").alias("__norm"), F.col("metric").alias("__name")), "__norm", "left").join(first, "__norm", "left")
    found = F.col("__p.metric")
    return out.select(*rows.columns, F.coalesce("__id", "__name", found).alias("metric"), ladder([(F.col("__id").isNotNull(), 0), (F.col("__name").isNotNull(), 10), (found.isNotNull(), 20)], 999).alias("match_priority"))


#: Multipliers of units and currencies in words. Fixed values.
UNITS = {"thousand": 1e3, "thousands": 1e3, "k": 1e3, "million": 1e6, "millions": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9, "천": 1e3, "만": 1e4, "백만": 1e6, "억": 1e8, "조": 1e12}


def unit_multiplier(unit: Column | str) -> Column:
    """1 for an unknown or missing unit."""
    unit = F.col(unit) if isinstance(unit, str) else unit
    table = F.create_map(*(F.lit(x) for p in UNITS.items() for x in p))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(unit))), F.lit(1.0))


def best_filing(rows: DataFrame, filings: DataFrame, key: str, row_key: str) -> DataFrame:
    """Each row's filing by accession, report code, period end, name and month text: earlier criteria outweigh all later ones, then the latest filing.

    A cascade of keyed lookups in one join: the filings are indexed by every subset of the first three criteria, with and
    without each month in their name, and only the best of an entry is kept; a row asks for the entries of its own values,
    and the answer to the strictest question stands. A row whose accession is filed asks only for entries with it, any other only
    for those without, and an accession that no row names is not in the index. No row meets the filings of its key one by one.
    The questions are dealt by their keys at every size: Spark takes them for no larger than the rows, and would broadcast them.
    """
    criteria = ("accession", "report_code", "period_end")
    text = {c for c in criteria if rows.schema[c].dataType != filings.schema[c].dataType}

    def entries(levels: Sequence[int]) -> list[Column]:
        out = []
        for n in levels:
            used = [c for bit, c in zip((4, 2, 1), criteria, strict=True) if n & bit]
            whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in used), F.lit(True))
            out.append(F.when(whole, F.struct(F.lit(n).alias("level"), *(F.when(F.lit(c in used), F.col(c)).alias(c) for c in criteria))))
        return out

    def marked(df: DataFrame) -> DataFrame:
        same = (F.col("__k") == F.col("__h.k")) & (F.col("accession") == F.col("__h.a"))
        return df.join(hits, same, "left")

    unified = lambda df, *cols: df.select(*cols, *(F.col(c).cast("string").alias(c) if c in text else F.col(c) for c in criteria))
    found = F.coalesce(F.regexp_extract_all("name", F.lit(r"(?=(\d{4}\.\d{2}))"), F.lit(1)), F.array().cast("array<string>"))
    best = F.struct(F.coalesce(F.contains("name", F.lit("report")).cast("int"), F.lit(0)).alias("report"), F.struct("filing_date", F.col("accession").alias("filing")).alias("f"))
    filed = unified(filings, F.col(key).alias("__k"), best.alias("__f"), F.array_union(F.array(F.lit("")), found).alias("__months"))
    asked = unified(rows, F.col(row_key).alias("__row"), F.col(key).alias("__k"), F.array_compact(F.array(F.lit(""), F.date_format("period_end", "yyyy.MM"))).alias("__months"))
    named = asked.select("__k", "accession", F.lit(0).alias("s")).unionByName(filed.select("__k", "accession", F.lit(1).alias("s"))).where("__k IS NOT NULL AND accession IS NOT NULL")
    hits = named.groupBy("__k", "accession").agg(F.min("s").alias("a"), F.max("s").alias("z")).where("a < z").select(F.struct(F.col("__k").alias("k"), F.col("accession").alias("a")).alias("__h"))
    with_it, without = entries(range(4, 8)), entries(range(4))
    hit = F.col("__h").isNotNull()
    index = marked(filed).select("__k", "__f", "__months", F.explode(F.array_compact(F.array(*without, *(F.when(hit, e) for e in with_it)))).alias("__entry"))
    index = index.select("__k", "__entry", F.explode("__months").alias("__month"), "__f").groupBy("__k", "__entry", "__month").agg(F.max("__f").alias("__f"))
    put = marked(asked).select("__row", "__k", "__months", F.explode(F.array_compact(F.when(hit, F.array(*with_it)).otherwise(F.array(*without)))).alias("__entry"))
    put = put.select("__row", "__k", "__entry", F.explode("__months").alias("__month"))
    met = put.hint("merge").join(index, ["__k", "__entry", "__month"])
    answer = F.struct(F.col("__entry.level").alias("level"), F.col("__f.report").alias("report"), (F.col("__month") != "").alias("m"), F.col("__f.f").alias("f"))
    chosen = met.groupBy(F.col("__row").alias(row_key)).agg(F.max(answer).alias("b"))
    return rows.join(chosen, row_key, "left").select(*rows.columns, F.col("b.f.filing").alias("filing"), F.col("b.f.filing_date").alias("filing_date"))


def identifier_links(companies: DataFrame, securities: DataFrame) -> DataFrame:
    """(company, security, valid_from, valid_to): same eight characters of the CUSIP or the same ticker, years overlapping.

    Two equi-joins and a distinct: an OR in one join would compare all pairs.
    """
    c = companies.select("company", F.substring("cusip", 1, 8).alias("c8"), F.upper(F.trim("ticker")).alias("tk"), F.col("first_year").alias("cf"), F.col("last_year").alias("cl"))
    s = securities.select("security", F.substring("cusip", 1, 8).alias("c8"), F.upper(F.trim("ticker")).alias("tk"), F.col("first_year").alias("sf"), F.col("last_year").alias("sl"))
    both = c.join(s.drop("tk"), "c8").drop("c8", "tk").unionByName(c.join(s.drop("c8"), "tk").drop("c8", "tk"))
    return both.where("cf <= sl AND cl >= sf").select("company", "security", F.greatest("cf", "sf").alias("valid_from"), F.least("cl", "sl").alias("valid_to")).distinct()


def eps_with_source(net_income: str, diluted: str, basic: str, reported: str, period_end_shares: str) -> dict[str, Column]:
    """eps and eps_source: reported diluted, else per diluted, else per basic share; share counts beyond half to twice the period's end do not count."""
    sane = lambda c: F.when((F.col(c) / F.nullif(F.col(period_end_shares), F.lit(0.0))).between(0.5, 2), F.col(c))
    d, b = safe_div(net_income, sane(diluted), True), safe_div(net_income, sane(basic), True)
    return {"eps": F.coalesce(reported, d, b), "eps_source": ladder([(F.col(reported).isNotNull(), "reported"), (d.isNotNull(), "diluted"), (b.isNotNull(), "basic")])}


def gross_profit_proxy(revenue: str, cogs: str, gross: str, operating_income: str) -> Column:
    """Gross profit; revenue - cogs where it lacks, or where it is below the operating income and that margin fits."""
    rebuilt = F.col(revenue) - F.col(cogs)
    fits = (F.col(gross) < F.col(operating_income)) & (rebuilt >= F.col(operating_income)) & (F.col(revenue) > 0)
    return F.when(fits, rebuilt).otherwise(F.coalesce(gross, reconcile_signed(gross, rebuilt)))


def dominant_sign(total: Column, sign_of: str, key: str = "ticker") -> Column:
    """A rebuilt total that agrees with the sign that most values of the key have, else null."""
    share = F.avg((F.col(sign_of) > 0).cast("int")).over(Window.partitionBy(key))
    return F.when(F.signum(total) == F.when(share >= 0.5, 1.0).otherwise(-1.0), total)


def anomalies_mended(df: DataFrame, value: str, name: str, key: str = "ticker", year_factor: float = 2.8, spike: float = 20.0) -> DataFrame:
    """Negative values go; a fourth quarter of 2.8 times the median of its neighbours loses the three before if that fits; spikes are scaled or go."""
    w = by(key, order="period_end")
    near = F.array_compact(F.array(*(F.when(F.lag("fiscal_quarter", k).over(w) != 4, F.lag(value, k).over(w)) for k in (1, 2, 3)), *(F.when(F.lead("fiscal_quarter", k).over(w) != 4, F.lead(value, k).over(w)) for k in (1, 2, 3))))
    rows = df.withColumns({"__near": F.sort_array(F.filter(near, lambda x: x > 0)), "__three": F.lag(value, 1).over(w) + F.lag(value, 2).over(w) + F.lag(value, 3).over(w)})
    n = F.size("__near")
    half = F.floor((n - 1) / 2).cast("int")
    median = F.when(n > 0, (F.get("__near", half) + F.get("__near", F.floor(n / 2).cast("int"))) / 2)
    rows = rows.withColumn("__m", median)
    x, m, rest = F.col(value), F.col("__m"), F.col(value) - F.col("__three")
    scaled = lambda k: (x / k / m).between(0.2, 5)
    mended = F.when(x < 0, None).when((F.col("fiscal_quarter") == 4) & (x >= year_factor * m) & (x < spike * m), F.when((rest / m).between(0.1, 4), rest)).when(x >= spike * m, F.when(scaled(1e3), x / 1e3).when(scaled(1e6), x / 1e6)).otherwise(x)
    return rows.withColumn(name, mended).drop("__near", "__three", "__m")


def series_roughness(df: DataFrame, value: str, keys: Sequence[str], order: str = "period_end") -> DataFrame:
    """(keys, roughness): median absolute change of the logarithm over positive values."""
    positive = df.where(F.col(value) > 0)
    step = F.abs(F.ln(F.col(value)) - F.lag(F.ln(F.col(value))).over(by(*keys, order=order)))
    return positive.withColumn("__s", step).groupBy(*keys).agg(F.percentile("__s", 0.5).alias("roughness"))


def smoothest(df: DataFrame, candidates: Mapping[str, str], key: str = "ticker", order: str = "period_end") -> DataFrame:
    """(key, series): the candidate column whose series is smoothest; earlier names win ties."""
    long = df.unpivot([key, order], list(candidates.values()), "series", "value")
    rough = series_roughness(long, "value", [key, "series"], order)
    rank = F.create_map(*(F.lit(x) for k, c in enumerate(candidates.values()) for x in (c, k)))
    return rough.groupBy(key).agg(F.min_by("series", F.struct(F.coalesce("roughness", F.lit(float("inf"))), rank[F.col("series")])).alias("series"))


def price_bands(multiples: DataFrame, multiple: str, eps: DataFrame, keys: Sequence[str] = ("ticker",), points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9), least: int = 10, default: Sequence[float] = (8.0, 12.0, 16.0, 20.0, 25.0)) -> DataFrame:
    """eps times the quantiles of positive multiples, never falling from band to band; fewer than ten values take the default levels."""
    positive = F.when(F.col(multiple) > 0, F.col(multiple))
    q = F.percentile(positive, F.array(*map(F.lit, points)))
    levels = multiples.groupBy(*keys).agg(F.when(F.count(positive) >= least, q).otherwise(F.array(*map(F.lit, default))).alias("__q"))
    both = eps.join(levels, list(keys))
    return both.select(*eps.columns, *_bands(len(points)))


def own_price_bands(rows: DataFrame, multiple: str, keys: Sequence[str] = ("ticker",), points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9), least: int = 10, default: Sequence[float] = (8.0, 12.0, 16.0, 20.0, 25.0)) -> DataFrame:
    """price_bands() where the rows hold both eps and the multiple: one ordered pass by key without a join, which holds one key's multiples at a time."""
    own = Window.partitionBy(*keys)
    positive = F.when(F.col(multiple) > 0, F.col(multiple))
    q = F.percentile(positive, F.array(*map(F.lit, points))).over(own)
    levels = F.when(F.count(positive).over(own) >= least, q).otherwise(F.array(*map(F.lit, default)))
    return rows.withColumn("__q", levels).select(*(c for c in rows.columns if c != multiple), *_bands(len(points)))


def _bands(n: int) -> list[Column]:
    return [(F.col("eps") * F.array_max(F.slice("__q", 1, k + 1))).alias(f"band_{k + 1}") for k in range(n)]


def funnel(cross: DataFrame, steps: Mapping[str, Column], by_cols: Sequence[str]) -> DataFrame:
    """Mean number of rows that pass each further step, over the dates of a scenario, and how often each step was the one that left none."""
    marks, ok = {}, F.lit(True)
    for name, c in steps.items():
        ok = ok & F.coalesce(c, F.lit(False))
        marks[name] = ok
    daily = cross.groupBy(*by_cols, "date").agg(*(F.count_if(m).alias(n) for n, m in marks.items()))
    cause = ladder([(F.col(n) == 0, n) for n in marks], "selected")
    return daily.withColumn("__c", cause).groupBy(*by_cols).agg(*(F.avg(n).alias(n) for n in marks), *(F.count_if(F.col("__c") == n).alias(f"empty_at_{n}") for n in marks))
