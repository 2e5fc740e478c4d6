"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, storage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Ties each node's larger neighbours (or its smaller ones and itself) to the least node among them and it."""
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        out = repeats.with_least(sides, "a", "b").where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        out = repeats.with_least(down, "a", "b").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e")).select("e.*")
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, component) for every node of edges (a, b): component is the least node that links reach. No edges give no rows.

    Runs jobs: rounds of two stars until the edges stand still, which they do after some log(nodes) squared rounds at most.
    The edges of a node with very many of them are not gathered in one task.
    """
    edges, before = storage.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        last, edges = edges, storage.written(_stars(_stars(edges, True), False), "stars")
        storage.dropped(last)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select("a", F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("a"), "component").distinct())
