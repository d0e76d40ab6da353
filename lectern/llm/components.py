"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.textkit import KeyFilter, stored

#: Edge rows of one node from which it counts as a hub, and how many parts a hub's rows are dealt to.
HUB_ROWS, HUB_PARTS = 512, 128


def _beside(rows: DataFrame, least: DataFrame) -> DataFrame:
    """`rows` (a, b) joined to `least` (a, m, n) on a. The rows of hubs are dealt by b to HUB_PARTS parts, each with
    its copy of the hub's row, so that no task gets all rows of one node; that adds HUB_PARTS / HUB_ROWS rows a row at
    most. Which nodes are hubs is known by a filter of bounded size, which may take other nodes with them."""
    hubs = KeyFilter(least.where(F.col("n") >= HUB_ROWS), "a")
    (many, few), (many_least, few_least) = hubs.split(rows), hubs.split(least.drop("n"))
    part, parts = F.pmod(F.xxhash64("b"), F.lit(HUB_PARTS)), F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1)).cast("array<bigint>"))
    dealt = many.withColumn("part", part).join(many_least.withColumn("part", parts), ["a", "part"]).drop("part")
    return dealt.unionByName(few.join(few_least, "a"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a, b) with a > b: neighbours move to the least node near them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        moved = _beside(both, least).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = _beside(edges, least).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is a component's least node, itself included.

    Both stars of a round are written to the shared folder, so that lineage stays short and a lost executor costs a star.
    Self-loops and nulls are ignored; an empty table has no nodes.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(edges, "stars"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        edges = stored(_star(stored(_star(edges, True), "stars"), False), "stars")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for edges a[i] - b[i] among nodes 0 to n - 1."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label
