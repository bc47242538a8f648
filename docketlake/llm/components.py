"""Consolidating pairwise matches into groups.

Union-find runs inside the edge partitions as they are read; each keeps only a spanning
forest, and gives it out whenever ``rows_per_task`` nodes are held, so that no partition,
however large, holds more. The forests are then merged level by level through partitions of
about ``rows_per_task`` forest rows, until one such partition holds what is left and gives
the global components.

A forest over more nodes than a task may hold cannot shrink by merging alone, so every
level also retires nodes: each node points to the first of its roots, in an order that is
drawn anew for the level (no chain of names can delay it); nodes that none points to are
replaced by the one they point to and set aside. At least a constant share of the nodes
is expected to retire, so the levels are few and the work is a geometric sum. At the
end the nodes set aside take the group of the one they point to, last level first.

Skew: what a node points to may be one of very many rows; such rows, at most one for each
``rows_per_task``, are looked up by a broadcast, all others by a join.

Defined results: rows with a null id and self links connect nothing and name no node;
repeated and reversed rows count once; an empty edge table gives no groups. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions.charforms import canonical_tdoc
from docketlake.session import checkpoint, table

ROWS_PER_TASK = 500_000


def _stars(parent: dict, find: Callable) -> Iterator[pd.DataFrame]:
    nodes = [x for x, up in parent.items() if x != up]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pd.DataFrame({"node": part, "root": [find(x) for x in part]})


def local_forest(most: int = ROWS_PER_TASK) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Union-find over one partition of (node, root): every node but the roots, with its root; at most about ``most`` nodes are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def find(x):
            top = x
            while (up := parent[top]) != top:
                top = up
            while (up := parent[x]) != top:
                parent[x], x = top, up
            return top

        for pdf in batches:
            for a, b in zip(pdf["node"].to_numpy(), pdf["root"].to_numpy(), strict=True):
                ra = find(a) if parent.setdefault(a, a) != a else a
                rb = find(b) if parent.setdefault(b, b) != b else b
                if ra < rb:
                    parent[rb] = ra
                elif rb < ra:
                    parent[ra] = rb
            if len(parent) > most:
                yield from _stars(parent, find)
                parent.clear()
        yield from _stars(parent, find)

    return run


def _forest(pairs: DataFrame, most: int) -> DataFrame:
    return pairs.select("node", "root").mapInPandas(local_forest(most), pairs.select("node", "root").schema)


def _looked_up(rows: DataFrame, key: str, found: DataFrame, most: int) -> DataFrame:
    """rows with ``to``, the value of found (k, to) for their key, else the key itself."""
    hot = rows.groupBy(key).count().where(F.col("count") > most).select(F.col(key).alias("k"))
    hot = checkpoint(hot.join(found, "k", "left"))  # at most a row for each ``most`` rows
    k = F.col(key) == F.col("k")
    known = rows.join(F.broadcast(hot), k)
    rest = rows.join(F.broadcast(hot.select("k")), k, "left_anti").join(found, k, "left")
    return known.unionByName(rest).withColumn("to", F.coalesce("to", key)).drop("k")


def _contracted(forest: DataFrame, level: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(edges between the nodes that stay, (node, up) of those that retire)."""
    both = forest.select(F.col("node").alias("x"), F.col("root").alias("y")).union(forest.select("root", "node"))
    order = F.struct(F.xxhash64("y", F.lit(level)), "y")
    up = both.groupBy("x").agg(F.min_by("y", order).alias("up"))
    # a node that comes before all its neighbours points to none, so that no two nodes point to each other
    up = checkpoint(up.where(F.struct(F.xxhash64("up", F.lit(level)), F.col("up").alias("y")) < F.struct(F.xxhash64("x", F.lit(level)), F.col("x").alias("y"))))
    retired = checkpoint(up.join(up.select(F.col("up").alias("x")).distinct(), "x", "left_anti"))
    to = retired.select(F.col("x").alias("k"), F.col("up").alias("to"))
    half = _looked_up(forest, "node", to, most).select(F.col("to").alias("node"), "root")
    edges = _looked_up(half, "root", to, most).select("node", F.col("to").alias("root")).where("node <> root")
    edges = edges.select(F.least("node", "root").alias("root"), F.greatest("node", "root").alias("node")).distinct()
    return checkpoint(edges.select("node", "root")), retired.select(F.col("x").alias("node"), "up")


def connected_components(edges: DataFrame, a: str, b: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(node, group_id) for every node in edges (a, b); group_id is the least node of its component."""
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("root")).where("node is not null and root is not null and node <> root")
    forest = checkpoint(_forest(pairs, rows_per_task))
    levels: list[DataFrame] = []
    while (rows := forest.count()) > rows_per_task:
        merged = checkpoint(_forest(forest.repartition(-(-rows // rows_per_task), "node"), rows_per_task))
        forest, retired = _contracted(merged, len(levels), rows_per_task)
        levels.append(retired)
    # one partition holds at most rows_per_task rows, whatever came before
    stars = _forest(forest.repartition(1), 2 * rows_per_task + 1)
    stars = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    if not levels:
        return stars.select("node", F.col("root").alias("group_id"))
    of = checkpoint(stars)
    for retired in reversed(levels):
        label = of.select(F.col("node").alias("k"), F.col("root").alias("to"))
        back = _looked_up(retired, "up", label, rows_per_task)
        whole = back.where("to = up").select(F.col("up").alias("node"), F.col("to").alias("root")).distinct()  # what stayed alone names itself
        of = checkpoint(of.unionByName(back.select("node", F.col("to").alias("root"))).unionByName(whole).distinct())
    least = of.groupBy("root").agg(F.min("node").alias("to")).withColumnRenamed("root", "k")
    return _looked_up(of, "root", least, rows_per_task).select("node", F.col("to").alias("group_id"))


FAMILY = ("revision_of", "merged_into", "approved_version_of")


def family_edges(spark, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "relationships").where(F.col("classification") == "candidate").where(F.col("relation_type").isin(*FAMILY))
    return r.select(canonical_tdoc(F.col("from_tdoc")).alias("a"), canonical_tdoc(F.col("to_tdoc")).alias("b"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return connected_components(family_edges(spark, sf_dir), "a", "b").select(F.col("node").alias("tdoc"), "group_id")
