"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a long, b long); component is the least node.

    Each round ties every node to the least neighbour it knows; minima are pre-aggregated, so that a node with many
    neighbours costs no more than its links. Rounds go on until every node either has only greater neighbours or one
    alone, a lesser one: then the links are stars around the least nodes.
    """
    links = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    ends = lambda one, two: F.struct(F.col(one).alias("u"), F.col(two).alias("v"))
    while True:
        both = links.select(F.explode(F.array(ends("u", "v"), ends("v", "u"))).alias("x")).select("x.*")
        near = checkpointed(both.groupBy("u").agg(F.min("v").alias("m"), (F.count(F.lit(1)) > 1).alias("several")))
        if not near.agg(F.bool_or(F.col("several") & (F.col("m") < F.col("u")))).first()[0]:
            return near.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        least = near.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", F.explode(F.array_distinct(F.array(ends("v", "m"), ends("u", "m")))).alias("x"))
        links = checkpointed(small.select("x.*").where("u != v").distinct())
