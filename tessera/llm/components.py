"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pinned
from tessera.operators.joins import skew_join


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Every round hangs the neighbours of a node on the smallest of them, larger ones first,
    then smaller ones; rounds end when only stars are left (logarithmic in the longest path).
    Nodes with very many neighbours meet them by broadcast, so no star is one task's.
    Nodes of any comparable type; edge endpoints must not be null; an empty table gives no rows."""
    while True:
        edges = pinned(_directed(edges))
        # done when every node hangs on one root, and no root hangs on another node
        nodes = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        odd = nodes.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1")
        if odd.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        total = 2 * edges.count()
        low = pinned(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = pinned(skew_join(both.filter("b > a"), low, ["a"], "n", total)
                       .select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = pinned(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = skew_join(large, low, ["a"], "n", total).select(F.explode(ends).alias("e")).select("e.*")


def _directed(edges: DataFrame) -> DataFrame:
    return (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
