"""Weakly connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valograph.operators.relational import semi_both_ends
from valograph.session import materialise

HEAVY = 1000  # a node on more than one in so many edges is looked up by broadcast; there are at most twice as many


def _with_least(edges: DataFrame, end: str, least: DataFrame) -> DataFrame:
    """Edges with ``_m``: the least neighbour of the node at ``end`` if it is smaller than the node, else the node itself."""
    total = edges.count()
    degree = edges.groupBy(end).agg(F.count(F.lit(1)).alias("_n"))
    heavy = degree.where(F.col("_n") * HEAVY > total).select(F.col(end).alias("_node"))
    known = least.select(F.col("_a").alias("_node"), F.col("_least").alias("_m"))
    hub = F.broadcast(heavy.join(known, "_node", "left"))
    apart = edges.join(F.broadcast(heavy), edges[end] == heavy["_node"], "left_anti").join(known, F.col(end) == F.col("_node"), "left")
    at_hub = edges.join(hub, edges[end] == hub["_node"])
    return at_hub.unionByName(apart).withColumn("_m", F.coalesce("_m", end)).drop("_node")


def weak_components(nodes: DataFrame, edges: DataFrame, node_id: str, source: str, target: str, max_rounds: int = 60) -> DataFrame:
    """Nodes with the smallest id of their component. Edges with an end outside the nodes connect nothing.

    Edges are kept from the larger to the smaller node. In one half of a round a node hands its larger neighbours to its
    least neighbour, in the other half its smaller ones, until every edge leads to the least node of its component. Least
    neighbours are partial minima; edges of a hub are never gathered in one task, since its one value is broadcast.
    """
    known = semi_both_ends(edges, nodes, node_id, source, target)
    larger, smaller = F.greatest(source, target).alias("_a"), F.least(source, target).alias("_b")
    links = materialise(known.where(F.col(source) != F.col(target)).select(larger, smaller).distinct())
    least_of = lambda e: materialise(e.groupBy("_a").agg(F.min("_b").alias("_least")))
    for _ in range(max_rounds):
        least = least_of(links)
        lifted = _with_least(links, "_b", least)
        lifted = materialise(lifted.select("_a", F.col("_m").alias("_b"), (F.col("_m") < F.col("_b")).alias("_moved")).groupBy("_a", "_b").agg(F.max("_moved").alias("_moved")))
        least = least_of(lifted)
        met = _with_least(lifted, "_a", least)
        moved = F.col("_moved") | (F.col("_m") < F.col("_b"))
        # The node itself and each of its other smaller neighbours now lead to the least of them.
        ends = F.explode(F.when(F.col("_m") < F.col("_b"), F.array("_a", "_b")).otherwise(F.array("_a"))).alias("_a")
        links = materialise(met.select(ends, F.col("_m").alias("_b"), moved.alias("_moved")).groupBy("_a", "_b").agg(F.max("_moved").alias("_moved")))
        if links.where("_moved").isEmpty():
            break
        links = links.drop("_moved")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    least = least_of(links)
    joined = nodes.select(F.col(node_id).alias("_id")).join(least, F.col("_id") == F.col("_a"), "left")
    return joined.select(F.col("_id").alias(node_id), F.coalesce("_least", "_id").alias("component"))
