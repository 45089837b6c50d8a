"""Shared-nearest-neighbour graph with Jaccard pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcell.functions.exprs import smallest_overlap

HOT = 2048


def snn_edges(neighbours: DataFrame, k: int, prune: float, hot: int = HOT) -> DataFrame:
    """``src, dst, shared, jaccard`` with ``src < dst``: pairs whose neighbour sets overlap enough.

    ``neighbours`` is ``src, dst`` with each cell in its own set. The Jaccard index is
    ``v / (2k - v)`` for ``v`` shared neighbours, so the threshold asks for a smallest
    ``v``. Two sets that share ``v`` cells must share one among the first
    ``size - v + 1`` of each in any common order; rare neighbours come first, so hubs drop
    out of most prefixes. Hubs that stay are split into blocks of ``hot`` cells whose block
    pairs are separate join keys. A pair is emitted only at its first common cell, which
    makes every pair appear once without a distinct.
    """
    least = max(1, smallest_overlap(k, prune))
    freq = neighbours.groupBy("dst").agg(F.count("*").alias("f"))
    sets = neighbours.join(freq, "dst").groupBy("src").agg(
        F.sort_array(F.collect_list(F.struct("f", "dst"))).alias("e")
    )
    sets = sets.select("src", "e", F.col("e.dst").alias("members"))
    prefix = F.slice("e", 1, F.greatest(F.lit(0), F.size("e") - least + 1))
    tokens = sets.withColumn("t", F.explode(prefix)).select("src", "members", F.col("t.dst").alias("token"), F.col("t.f").alias("f"))
    tokens = tokens.withColumn("nb", F.ceil(F.col("f") / hot).cast("int")).withColumn("b", F.pmod(F.xxhash64("src"), F.col("nb")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = tokens.withColumn("c", every).select("token", F.col("b").alias("bl"), F.col("c").alias("br"), F.col("src").alias("a"), F.col("members").alias("am"))
    right = tokens.withColumn("c", every).select("token", F.col("c").alias("bl"), F.col("b").alias("br"), F.col("src").alias("z"), F.col("members").alias("zm"))
    both = left.join(right, ["token", "bl", "br"]).filter("a < z").withColumn("common", F.array_intersect("am", "zm"))
    shared = F.size("common")
    return both.filter((F.col("common")[0] == F.col("token")) & (shared >= least)).select(
        F.col("a").alias("src"), F.col("z").alias("dst"), shared.alias("shared"), (shared / (2 * k - shared)).alias("jaccard")
    )


def snn_graph(neighbours: DataFrame, k: int, prune: float) -> DataFrame:
    """The edge list of the graph: both directions and a loop per cell."""
    half = snn_edges(neighbours, k, prune)
    back = half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "shared", "jaccard")
    loops = neighbours.groupBy("src").agg(F.count("*").cast("int").alias("shared")).filter(
        F.col("shared") / (2 * k - F.col("shared")) > prune
    )
    loops = loops.select("src", F.col("src").alias("dst"), "shared", (F.col("shared") / (2 * k - F.col("shared"))).alias("jaccard"))
    return half.unionByName(back).unionByName(loops)
