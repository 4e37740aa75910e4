"""Connected components of a table of links, as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _moving(edges: DataFrame) -> DataFrame:
    """Nodes that don't hang on one node alone, or hang on a node that hangs on another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node long, label long) for every node of ``links`` (a long, b long); the label
    is the smallest node reachable.

    Alternating large-star and small-star steps: every node passes its smallest
    neighbour to its larger, then to its smaller neighbours, until each node hangs on
    the smallest of its component, which the edges themselves show. Steps are aggregates and joins over links, whose
    number never grows; each is stored, so lineage stays short.
    """
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    for _ in range(rounds):
        if not _moving(edges).take(1):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = stage(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct(), name)
    raise RuntimeError("components did not settle")
