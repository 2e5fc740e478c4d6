"""Products of two sources: names matched by containment over an index of their letters, units made comparable, values compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rules

#: Scales of units by the first of these that the unit holds. Fixed values.
SCALES = (("조", 1e12), ("억", 1e8), ("백만", 1e6), ("만", 1e4), ("천", 1e3))
#: Physical units, which amounts of money are not compared with; the word of money, of time, and of totals. Fixed values.
PHYSICAL, MONEY, TIME, TOTALS = ("대", "톤", "ton", "m/t", "kl", "㎘", "개", "mwh"), "원", "시간", ("합계", "소계", "총계")
#: The section whose values are rates as they are. Fixed value.
RATES = "가동률"


def product_key(name: Column | str) -> Column:
    """A name in lower case without remarks in brackets, division and plant words and dashes, single-spaced."""
    out = F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"[\s　 ]+", " ")
    out = F.regexp_replace(F.regexp_replace(F.trim(out), r"\s*부문$", ""), r"\s*부문\s+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*\([^)]*\)", " "), r"&cr|[-–—]|공장", " ")
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def unit_scale(unit: Column | str, section: Column | str) -> Column:
    """By what a value in a unit is multiplied to count single ones; 1 for rates and unknown units."""
    unit = F.regexp_replace(F.regexp_replace(F.col(unit) if isinstance(unit, str) else unit, r"[\s　 ]+", ""), r",?%", "")
    unit = F.element_at(F.split(unit, "[,，]"), 1)
    out = F.when((F.col(section) if isinstance(section, str) else section) == RATES, 1.0)
    for word, scale in SCALES:
        out = out.when(F.contains(unit, F.lit(word)), scale)
    return F.coalesce(out, F.lit(1.0))


def comparable(unit: Column | str, section: Column | str, expected: Column | str) -> Column:
    """Whether values in a unit can be compared with those of an expected unit: not time, nor money with things."""
    own = F.lower(F.regexp_replace(F.coalesce(F.col(unit) if isinstance(unit, str) else unit, F.lit("")), r"[\s　 ]+", ""))
    want = F.lower(F.coalesce(F.col(expected) if isinstance(expected, str) else expected, F.lit("")))
    rate = (F.col(section) if isinstance(section, str) else section) == RATES
    money = F.contains(own, F.lit(MONEY))
    odd = F.startswith(own, F.lit(TIME)) | (want.isin(*PHYSICAL) & money) | (F.contains(want, F.lit(MONEY)) & ~money & ~own.isin("", "%"))
    return F.coalesce(rate, F.lit(False)) | (own == "") | ~odd


def _fits(a: str, b: str) -> Column:
    """Whether two different keys, of which one holds the other, name one product: b within a starts or ends at a word, and covers 0.6 of a word that it only starts; 0.3 of the longer name is shared, from four letters on."""
    a_, b_ = F.col(a), F.col(b)
    at, size = F.instr(a_, b_), F.length(b_)
    starts = (at == 1) | (F.substring(a_, at - 1, F.lit(1)) == " ")
    following = F.substring(a_, at + size, F.lit(1))
    ends = following.isin("", " ")
    gap = F.instr(F.substring(a_, at + size, F.length(a_)), " ")
    word = F.when(gap > 0, size + gap - 1).otherwise(F.length(a_) - at + 1)
    bounded = (at == 0) | (a_ == b_) | ends | (starts & (size / word >= 0.6))
    overlap = F.least(F.length(a_), size)
    return bounded & ((overlap < 4) | (overlap / F.greatest(F.length(a_), size) >= 0.3))


def matched_products(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "name", period: str = "period", value: str = "value", unit: str = "unit") -> DataFrame:
    """(keys, name, match, overlap): for each left name the right one that names the same product best.

    left: (keys, section, name, period, value), right: the same and a unit; keys hold the section. One name must hold the other,
    as product_key(); keys of two letters or more meet by the first letters of the shorter one, never all with all. The longest
    overlap wins; for left names under ten letters a total goes before. If several share the longest overlap, the one whose last
    value, as it is, annualised or by quarter, is nearest to the left one's last value other than 0 wins; then the first name.
    """
    last = lambda c, ok, *tie: F.max_by(c, F.when(ok, F.struct(period, value, *tie)))
    ones = left.groupBy(*keys, name).agg(last(F.col(value), F.col(value).isNotNull() & (F.col(value) != 0)).alias("__want")).withColumn("__a", product_key(name))
    twos = right.groupBy(*keys, F.col(name).alias("match")).agg(last(F.struct(F.col(value).alias("v"), F.col(unit).alias("u"), F.col(period).alias("p")), F.col(value).isNotNull(), F.coalesce(unit, F.lit(""))).alias("__last")).withColumn("__b", product_key("match"))
    ones, twos = ones.where(F.length("__a") >= 2), twos.where(F.length("__b") >= 2)
    head = lambda c: F.substring(c, 1, rules.GRAM)
    spread = lambda df, c: df.withColumn("__g", F.explode(rules.grams(c)))
    on = [*keys, "__g"]
    within = spread(ones, "__a").join(twos.withColumn("__g", head("__b")), on).where(F.contains("__a", F.col("__b")))
    around = ones.withColumn("__g", head("__a")).join(spread(twos, "__b"), on).where(F.contains("__b", F.col("__a")) & (F.col("__a") != F.col("__b")))
    found = within.unionByName(around).drop("__g").where(_fits("__a", "__b")).withColumn("overlap", F.least(F.length("__a"), F.length("__b")))
    total = F.lit(False)
    for t in TOTALS:
        total = total | F.contains("match", F.lit(t))
    month, own = F.month("__last.p"), F.col("__last.v") * unit_scale(F.col("__last.u"), keys[-1])
    trials = [own, F.when(month.isin(3, 6, 9), own * (12 / month)), F.when(month.isin(3, 6, 9), own / F.floor(month / 3))]
    far = F.least(*(F.abs(t - F.col("__want")) for t in trials))
    group = Window.partitionBy(*keys, name)
    found = found.withColumns({"__total": total, "__far": far, "__top": F.col("overlap") == F.max("overlap").over(group)})
    found = found.withColumn("__near", F.when(F.col("__top") & (F.count_if("__top").over(group) > 1), F.col("__far")))
    order = [F.col("__near").asc_nulls_last(), (F.col("__total") & (F.length("__a") < 10)).desc(), F.col("overlap").desc(), F.col("match")]
    return found.withColumn("__n", F.row_number().over(group.orderBy(*order))).where("__n = 1").select(*keys, name, "match", "overlap")


def product_errors(left: DataFrame, right: DataFrame, matches: DataFrame, keys: Sequence[str], name: str = "name", period: str = "period", value: str = "value", unit: str = "unit", expected: str = "expected") -> DataFrame:
    """(keys, name, match, period, value, matched_value): periods that a matched pair has in common, in single units, where those can be compared. Of several rows of one product and period the largest counts."""
    two = right.where(F.col(value).isNotNull()).groupBy(*keys, F.col(name).alias("match"), period).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(unit).alias("u")), F.struct(value, F.coalesce(unit, F.lit("")))).alias("__r"))
    both = left.where(F.col(value).isNotNull()).join(matches, [*keys, name]).join(two, [*keys, "match", period])
    kept = both.where(comparable(F.col("__r.u"), keys[-1], expected))
    return kept.select(*keys, name, "match", period, value, (F.col("__r.v") * unit_scale(F.col("__r.u"), keys[-1])).alias("matched_value"))
