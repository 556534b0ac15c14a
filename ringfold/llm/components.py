"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round hangs each node's neighbours under the smallest of them, so a chain of n nodes
shrinks in O(log n) rounds and no node's neighbours are gathered: both stars are a minimum
by key and a join. Each round's links are written to the shared folder, so lineage stays
short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.llm.shared import settled


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reachable.

    Links may repeat, stand in either direction, or join a node with itself; those with a
    null end are no links. Without links the result is empty.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges, before = settled(edges), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = settled(_small_star(_large_star(edges)))
    nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("v").alias("n"), F.col("u").alias("w")).unionByName(edges.select(F.col("u").alias("n"), F.col("v").alias("w")))
    least = both.groupBy("n").agg(F.least(F.min("w"), F.first("n")).alias("m"))
    return both.where("w > n").join(least, "n").select(F.col("w").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of those."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
    return moved.unionByName(least.select("v", F.col("m").alias("u"))).distinct()
