"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the smallest node of its component.

    In each round every root that has a smaller neighbour root hangs itself under the smallest, the
    trees are flattened by pointer jumping, and the edges are drawn anew between roots. Every component
    but the finished ones loses roots in each round. All sums are minima, which merge before the
    shuffle; nothing is gathered.
    """
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = scratch.table(edges.select(F.col("u").alias("node")).unionAll(edges.select(F.col("v").alias("node"))).distinct().withColumn("label", F.col("node")))
    links = edges
    for _ in range(rounds):
        links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        links = scratch.table(links)
        if links.isEmpty():
            return labels
        tree = scratch.table(links.groupBy("u").agg(F.min("v").alias("up")))
        for _ in range(rounds):
            above = tree.select(F.col("u").alias("w"), F.col("up").alias("higher"))
            jumped = scratch.table(tree.join(above, F.col("up") == F.col("w"), "left").select("u", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")))
            tree = jumped.select("u", "up")
            if jumped.filter("moved").isEmpty():
                break
        labels = scratch.table(labels.join(tree, F.col("label") == F.col("u"), "left").select("node", F.coalesce("up", "label").alias("label")))
        a, b = (tree.select(F.col("u").alias(f"{s}_u"), F.col("up").alias(f"{s}_up")) for s in "ab")
        links = links.join(a, F.col("u") == F.col("a_u"), "left").join(b, F.col("v") == F.col("b_u"), "left")
        links = links.select(F.coalesce("a_up", "u").alias("u"), F.coalesce("b_up", "v").alias("v"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
