"""Connected components without collecting links: alternating large-star and small-star rounds.

Each round points nodes to smaller neighbours until every component is a star around its smallest node. A round
is made of pre-aggregated minima and joins, and is staged, so lineage stays short and nothing grows on the
driver. Self links and repeated links do no harm; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.plans.staging import discard, stage


def _towards_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with b replaced by the least of all b of a; that least one is linked to b too."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least.withColumnRenamed("a", "x"), F.col("a") == F.col("x")).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    star = _towards_least(both)
    return star.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    star = _towards_least(edges)  # b < a here
    moved = star.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return star.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the least node that can be reached."""
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    edges, state = stage(edges, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            break
        state = now
        made = stage(_small_star(_large_star(edges)), "links")
        discard(edges)
        edges = made
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
