"""Connected components of a graph whose edges are a table: alternating large-star and small-star steps.

Each step sends an edge once to its larger or its smaller end and links neighbours to the least one; the number of steps
is about the logarithm of the longest path. State is a written table after each round, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausecut.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Of each node's neighbours, the larger ones (or, small star, the smaller ones and itself) link to the least."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """From edges (a, b) over longs: (node, comp) for every node with an edge, comp being the least node it reaches."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-edges", compact=True)
    state, old, k = None, f"{label}-edges", 0
    while True:
        k += 1
        now = scratch.write(_star(_star(now, True), False), f"{label}-{k}", compact=True)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(old)
        old = f"{label}-{k}"
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
