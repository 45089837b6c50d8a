"""Connected components by alternating large-star and small-star steps.

An edge always points from the larger node to the smaller one. A large-star step hangs the
larger neighbours of every node on the smallest node it knows, a small-star step hangs the
smaller ones there; the edges shrink to stars around the smallest node of each component
(Kiveris et al. 2014). The loop ends when a pass changes no edge, however many passes that
takes. Nothing is gathered by node: minima are partial aggregates, and the join that hands
them back has one row per node on one side, so Spark can split a hub on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcell.session import discard, written


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("hi <> lo").groupBy("hi", "lo").agg(F.count("*").alias("_n")).select("hi", "lo")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
    # seen from node u (here ``lo``), its larger neighbours move to the least node u knows
    return _distinct(edges.join(least.select(F.col("hi").alias("lo"), "m"), "lo").select("hi", F.col("m").alias("lo")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return _distinct(moved.unionByName(least.select("hi", F.col("m").alias("lo"))))


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.lit(0)).alias("h")
    ).first()
    return int(row.n), int(row.h)


def component_stars(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node that has an edge to another node.

    ``edges`` is ``src, dst`` in any direction, repeated or not; ends that are null, and
    loops, count as no edge.
    """
    spark = edges.sparkSession
    current = edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).filter(
        F.col("src").isNotNull() & F.col("dst").isNotNull()
    )
    current, path = written(_distinct(current), "stars")
    state = _digest(current)
    while state[0]:
        stepped, next_path = written(_small_star(_large_star(current)), "stars")
        reached = _digest(stepped)
        discard(spark, path)
        current, path, before, state = stepped, next_path, state, reached
        if before == reached:
            break
    leaves = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = current.groupBy("lo").agg(F.count("*").alias("_n")).select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return leaves.unionByName(roots)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node of each node's component."""
    stars = component_stars(edges)
    return nodes.select("node").join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
