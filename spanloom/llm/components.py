"""Connected components of a graph given as a table of edges.

Alternating stars: in turn every node's larger neighbours, then its smaller
ones, are hung onto the smallest node it knows of. The number of rounds grows
with the logarithm of the longest chain. Each step is an aggregation (combined
before the shuffle) and a join (whose hot keys adaptive execution splits), so no
node's neighbours ever meet in one task. Rounds end in reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of its component, for each node with an edge.

    Edges with a null end or both ends equal say nothing and are ignored;
    repeated ones count once.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    stars = checkpointed(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        stars = checkpointed(_small(_large(stars)))
        state = stars.agg(
            F.count("*").alias("edges"), F.bit_xor(F.xxhash64("u", "v")).alias("hash"), F.min("v").alias("least")
        ).first()
        if state == seen:
            break
        seen = state
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _large(stars: DataFrame) -> DataFrame:
    both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u").join(least, "u")
    # Repeats go in the small step, one shuffle later.
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(stars: DataFrame) -> DataFrame:
    """Here every ``u`` is greater than its ``v``."""
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    hung = stars.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()
