"""Connected components of edge tables by repeated contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweft.plans.staging import remove, stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); nodes of one component share one root.

    Each round every node moves to the first of itself and its neighbours, in an order that changes from
    round to round, and edges are renamed and made distinct; the edges shrink by a constant factor a round.
    The first order is the node itself, so stars vanish at once. Null ends and loops are dropped.
    """
    labels, held, turn = None, None, 0
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), name)
    while not edges.isEmpty():

        def rank(c: str, turn: int = turn) -> Column:
            return F.struct(F.lit(0) if turn == 0 else F.xxhash64(F.lit(turn), F.col(c)), F.col(c).alias("node"))

        both = edges.union(edges.select("b", "a"))
        moves = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.min(rank("a")))["node"].alias("to"))
        moves = stage(moves, name)
        ends = edges
        for c in ("a", "b"):
            ends = ends.join(moves.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")), c)
        left = stage(ends.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
        if labels is None:
            labels, held = moves.select("node", F.col("to").alias("root")), moves
        else:
            step = moves.select(F.col("node").alias("root"), "to")
            new = stage(labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), name)
            remove(moves, held)
            labels = held = new
        remove(edges)
        edges, turn = left, turn + 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
