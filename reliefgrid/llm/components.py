"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.session import cut


def _stars(edges: DataFrame, smaller: bool) -> DataFrame:
    """Links each neighbour of a node to the smallest node around it.

    ``smaller`` looks at neighbours below the node only, otherwise larger ones are relinked.
    """
    if smaller:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("k"), F.least("u", "m").alias("m")
    )
    moved = around.join(least, F.col("u") == F.col("k"))
    if smaller:
        pairs = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("k").alias("a"), F.col("m").alias("b"))
        )
    else:
        pairs = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return pairs.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b``; the label is the smallest node reachable.

    Each round is written to the shared folder, so lineage stays short and lost executors only
    repeat a round. Rounds grow with the logarithm of the longest chain. Loops and repeated
    edges are allowed; an empty table gives an empty result.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).head()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        edges = cut(_stars(_stars(edges, False), True))
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
