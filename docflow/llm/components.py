"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is one grouping and one join over the edges; both keep every component connected, and O(log n)
rounds suffice in practice. Edges are written to the shared folder after each round, so lineage stays short, and
those of the round before are deleted. A node that holds more than a share of 1 / HUBS of the edges gets its least
neighbour by a broadcast of such nodes, of which there are at most 2 * HUBS, so that no task has to hold its edges.
Nodes are integers; loops and repeated edges do no harm, edges with a null end are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import forget, written

#: Bounds the nodes whose least neighbours are broadcast; smaller ones than this many edges are never hubs.
HUBS, LEAST_HUB = 500, 1000


def _stars(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """Large: links a node's greater neighbours to its least one. Small: its lesser neighbours and itself."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    of_hubs = least.where(F.col("n") > hub).select("u", F.col("m").alias("of_hub"))
    near = near.join(F.broadcast(of_hubs), "u", "left")
    plain = near.where("of_hub is null").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    joined = plain.select("u", "v", "m").unionByName(near.where("of_hub is not null").select("u", "v", F.col("of_hub").alias("m")))
    if large:
        found = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        found = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return found.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[bool, int]:
    """Whether every component is a star around its least node (no node is the greater end of two edges, or of one
    edge and the lesser of another), and the number of edges."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    found = seen.agg(F.count_if(F.expr("up > 1 or (up = 1 and root = 1)")).alias("wrong"), F.sum("up").alias("edges")).first()
    return found.wrong == 0, found.edges or 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node that an edge links: (node, root), the least node of its component."""
    edges = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    while True:
        done, n = _state(edges)
        if done:
            break
        hub = max(LEAST_HUB, n // HUBS)
        after = written(_stars(_stars(edges, True, hub), False, hub), "edges")
        forget(edges)
        edges = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
