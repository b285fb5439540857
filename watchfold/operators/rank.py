"""Rank of nodes by power iteration over weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

DAMPING = 0.85


def page_rank(edges: DataFrame, src: str, dst: str, weight: str = "weight", damping: float = DAMPING, rounds: int | None = None, tolerance: float = 1e-9, most: int = 200) -> DataFrame:
    """(node, rank) of every end of edges; ranks add up to 1.

    A node passes its rank on along its edges in proportion to their weights. What nodes without edges of their own hold
    goes to all nodes alike. rounds: so many; otherwise until no round moves more than tolerance in all, `most` rounds at
    most. A round is two joins by node and a pre-aggregated sum; its result, used three times, is written before the next.
    Parallel edges add up, and edges of a null end or of no weight do not count.
    """
    own = edges.where(f"`{src}` IS NOT NULL AND `{dst}` IS NOT NULL AND `{weight}` > 0")
    own = own.groupBy(F.col(src).alias("node"), F.col(dst).alias("to")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    total = own.groupBy("node").agg(F.sum("w").alias("all"))
    shares = checkpointed(own.join(total, "node").select("node", "to", (F.col("w") / F.col("all")).alias("share")))
    nodes = checkpointed(shares.select("node").union(shares.select("to")).distinct().join(shares.select("node", F.lit(1).alias("has")).distinct(), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(most if rounds is None else rounds):
        flows = shares.join(rank.where("has = 1").select("node", "rank"), "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("gain"))
        idle = rank.agg(F.coalesce(F.sum(F.when(F.col("has").isNull(), F.col("rank"))), F.lit(0.0)).alias("idle"))
        new = F.lit((1 - damping) / n) + damping * (F.coalesce("gain", F.lit(0.0)) + F.col("idle") / n)
        moved = rank.join(flows, "node", "left").crossJoin(F.broadcast(idle)).select("node", "has", new.alias("rank"), F.col("rank").alias("before"))  # idle: one row
        moved = checkpointed(moved)
        rank = moved.select("node", "has", "rank")
        if rounds is None and moved.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("before"))), F.lit(0.0))).first()[0] <= tolerance:
            break
    return rank.select("node", "rank")
