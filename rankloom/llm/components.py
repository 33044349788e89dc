"""Connected components of an undirected graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import Scratch


def smallest_reachable(edges: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(node, root): for every node of ``edges(a, b)`` the smallest node it is connected to,
    itself included.

    Each round points a node's larger neighbours, then its smaller ones, to the smallest node
    it knows (large star, small star), until nothing changes. A node's minimum is a grouped
    ``min`` with partial sums before the shuffle and comes back through a join, so a node with
    very many neighbours is never gathered in one task; the rounds grow with the logarithm of
    the number of nodes. Every round is a table in the shared folder; the one before it is
    deleted. Null endpoints and self-links are ignored."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = scratch.write(e.filter("u > v").distinct(), f"{name}_0")
    rounds, before = 0, None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .filter("u > v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        rounds += 1
        e = scratch.write(small, f"{name}_{rounds}")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}_{rounds - 1}")
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
