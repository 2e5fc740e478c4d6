"""Ordered rules compiled to lookups: codes and ranges by aligned blocks, keywords by an inverted index of their first letters.

Rules meet the distinct codes and texts of the rows by equi-joins, and the least matching rule of each travels back to the rows. How a rule
table is sent to the tasks is left to Spark, which looks at its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sweep

#: Codes are whole numbers of 32 bits, counted from the least of them.
_BITS, _LEAST = 32, -(1 << 31)
#: Letters that the index holds of a keyword; shorter keywords are held whole.
GRAM = 3


def grams(c: str) -> Column:
    """All distinct runs of up to GRAM letters of a text."""
    runs = [f"coalesce(transform(if(length({c}) >= {n}, sequence(1, length({c}) - {n - 1}), NULL), k -> substring({c}, k, {n})), array())" for n in range(1, GRAM + 1)]
    return F.expr(f"array_distinct(concat({', '.join(runs)}))")


def first_contained(texts: DataFrame, text: str, keywords: DataFrame, keyword: str, order: str) -> DataFrame:
    """(text, order): for each distinct text the least `order` of the keywords that it holds; texts that hold none, and empty keywords, have no row."""
    index = keywords.where(F.length(keyword) > 0).groupBy(F.col(keyword).alias("__k")).agg(F.min(order).alias("__o")).withColumn("__g", F.substring("__k", 1, GRAM))
    asked = texts.select(text).where(F.col(text).isNotNull()).distinct()
    met = asked.withColumn("__g", F.explode(grams(f"`{text}`"))).join(index, "__g").where(F.contains(F.col(text), F.col("__k")))
    return met.groupBy(text).agg(F.min("__o").alias(order))


def first_in_ranges(codes: DataFrame, code: str, ranges: DataFrame, low: str, high: str, order: str) -> DataFrame:
    """(code, order): for each distinct code the least `order` of the closed ranges that hold it; codes are whole numbers of 32 bits."""
    number = lambda c: F.col(c).cast("long") - _LEAST
    spans = ranges.where(F.col(low) <= F.col(high)).select(number(low).alias("__a"), number(high).alias("__z"), order)
    index = spans.select(order, F.explode(sweep.cover("__a", "__z", str(_BITS))).alias("__block")).groupBy("__block").agg(F.min(order).alias("__o"))
    asked = codes.select(code).where(F.col(code).isNotNull()).distinct().withColumn("__p", number(code))
    met = asked.select(code, F.explode(sweep.blocks_of("__p", str(_BITS))).alias("__block")).join(index, "__block")
    return met.groupBy(code).agg(F.min("__o").alias(order))


def lookup(rows: DataFrame, rules: DataFrame, code: str, text: str, fallback: str, name: str = "label") -> DataFrame:
    """The rule of least priority whose exact code, range of codes, or any keyword fits; else the fallback.

    rules: (priority, code, low, high, keywords separated by |, label); of one priority the least code, range, keywords and label.
    Keywords are held anywhere in the text, in any case. A null code or text fits no rule by it.
    """
    packed = rules.withColumn("__rule", F.struct("priority", "code", "low", "high", "keywords", "label"))
    exact = packed.select(F.col("code").alias("low"), F.col("code").alias("high"), "__rule")
    ranges = exact.unionByName(packed.select("low", "high", "__rule"))
    words = packed.select("__rule", F.explode(F.split(F.lower("keywords"), r"\|")).alias("__word"))
    asked = rows.withColumns({"__code": F.col(code).cast("int"), "__text": F.lower(F.col(text))})
    by_code = first_in_ranges(asked, "__code", ranges, "low", "high", "__rule").withColumnRenamed("__rule", "__by_code")
    by_text = first_contained(asked, "__text", words, "__word", "__rule").withColumnRenamed("__rule", "__by_text")
    found = asked.join(by_code, "__code", "left").join(by_text, "__text", "left")
    return found.select(*(F.col(c) for c in rows.columns), F.coalesce(F.least("__by_code", "__by_text")["label"], F.lit(fallback)).alias(name))
