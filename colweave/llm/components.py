"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm.store import heavy_join, settle


def _stars(pairs: DataFrame, total: int) -> DataFrame:
    """Each node u's other ends v, with the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return heavy_join(pairs, settle(least, "least"), "u", "n", total=total).select("u", "v", F.least("u", "m").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = edges.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("z"))
    tops = edges.select(F.col("v").alias("u"), F.lit(True).alias("top")).distinct()
    return ends.join(tops.hint("merge"), "u", "left").where("a < z OR top").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes that have an edge, each with the least node of its component: node, component.

    Each round hangs the larger neighbours of every node on its least neighbour (large
    star), then the smaller ones (small star); the rounds end when each larger node has one
    smaller one, and that one no smaller one, after a number of rounds logarithmic in the
    longest path.
    A node of any degree costs its degree; minima are combined before the shuffle, and nodes
    of very many edges are joined by broadcast.
    """
    now = settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _are_stars(now):
        size = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(_stars(both, 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        small = _stars(large, size)
        hung = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
