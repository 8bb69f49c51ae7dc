"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node it reaches.

    Takes (src, dst) with src < dst. Alternating large-star and small-star steps: every
    node's larger neighbours, then its smaller ones, are hung onto the smallest
    neighbour. The neighbours of a node are never gathered: their minimum is a combining
    aggregate, joined back to the edges, so a node with very many edges is split. Every
    round is written to the shared folder.
    """
    edges = saved(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # Large star: dst > node, hung onto the smallest neighbour of node, or node itself.
        both = edges.union(edges.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("low"))
        large = edges.join(least, edges["src"] == least["node"]).select(F.col("low").alias("src"), "dst").distinct()
        large = saved(large, "large-star")
        # Small star: what is smaller than dst, and dst itself, hung onto the smallest of them.
        least = large.groupBy("dst").agg(F.min("src").alias("low")).withColumnRenamed("dst", "node")
        small = large.join(least, large["dst"] == least["node"])
        small = small.select("low", F.explode(F.array("src", "dst")).alias("other")).filter("low != other")
        edges = saved(small.select(F.col("low").alias("src"), F.col("other").alias("dst")).distinct(), "small-star")
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("root"))
