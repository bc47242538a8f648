"""Reaching documents along edges, to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.session import checkpoint


def reach(seeds: DataFrame, edges: DataFrame, within: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of the seeds (node) and all they reach along edges (src, dst), at the least depth.

    ``within`` (node) limits what may be entered, seeds aside. Cycles end because a node is
    entered once. Each round joins the edges with the last frontier and removes what is
    known; the frontier is checkpointed. Nulls and self edges are dropped. Without seeds or
    edges the seeds come back alone.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()
    if within is not None:
        edges = edges.join(within.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    edges = checkpoint(edges)
    seen = frontier = checkpoint(seeds.where("node is not null").select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = checkpoint(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 10 == 0:
            seen = checkpoint(seen)
    return seen


def closure(seeds: DataFrame, edges: DataFrame, files: DataFrame, direction: str = "forward") -> DataFrame:
    """(tdoc, depth): documents with a file that the seeds reach along valid edges.

    direction: forward (from a document to what it names), backward or both.
    """
    valid = edges.where("classification = 'candidate'").select("src", "dst")
    back = valid.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    use = {"forward": valid, "backward": back, "both": valid.union(back)}[direction]
    got = reach(seeds.select(F.col("tdoc").alias("node")), use, files.select(F.col("tdoc").alias("node")))
    return got.withColumnRenamed("node", "tdoc")
