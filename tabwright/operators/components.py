"""Connected components by contracting the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import cut


def follow(step: DataFrame) -> DataFrame:
    """(id, to): every chain id -> to -> ... replaced by its end, two doublings per checkpoint."""
    while True:
        for old in ("was", "mid"):
            onward = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
            step = step.join(onward, "to", "left").select(
                "id", F.coalesce("far", "to").alias("to"), F.col("to").alias(old)
            )
        step = cut(step)
        # settled when the last doubling moved nothing
        if step.where(F.col("to") != F.col("mid")).isEmpty():
            return step.select("id", "to")
        step = step.select("id", "to")


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest node id reachable from each node.

    ``nodes(id)``, ``edges(a, b)`` undirected. Each round sends every node to
    the least node among its neighbours and itself, follows such steps to their
    end (doubling the reach each time), and rewrites the edges between what is
    left. Only local minima stay, so at least half of the connected nodes leave
    per round and the edge table shrinks with them; minima and duplicate removal
    combine before the shuffle. Each round ends in a reliable checkpoint.
    """
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    live = cut(edges.select("a", "b").unionByName(back).where("a <> b").distinct())
    moves: list[DataFrame] = []
    while not live.isEmpty():
        if len(moves) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        step = live.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(
            "id", F.least("id", "m").alias("to")
        )
        move = follow(step)
        moves.append(move)
        live = (
            live.join(move.select(F.col("id").alias("a"), F.col("to").alias("pa")), "a")
            .join(move.select(F.col("id").alias("b"), F.col("to").alias("pb")), "b")
            .select(F.col("pa").alias("a"), F.col("pb").alias("b"))
            .where("a <> b")
            .distinct()
        )
        live = cut(live)
    label = nodes.select("id", F.col("id").alias("component"))
    for move in moves:
        hop = move.select(F.col("id").alias("component"), "to")
        label = label.join(hop, "component", "left").select(
            "id", F.coalesce("to", "component").alias("component")
        )
    return cut(label)
