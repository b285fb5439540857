"""What the operators over vectors share: valid vectors, and merging of top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vec: str) -> Column:
    """Whether a vector is neither null nor empty and has finite components only."""
    return (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) with doubles, without nulls, empty vectors, and vectors with null or non-finite components.

    An id that several rows have counts once, with its least vector.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & finite("vec")).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def merged(lists: DataFrame, k: int, part: str | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of (keys, vec_id, score), within each part if given: higher scores first, then smaller ids."""
    by = Window.partitionBy(*keys, *([part] if part else [])).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def merge_tree(lists: DataFrame, k: int, parts: int, fan_in: int = 16, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Lists by keys and part (from 0) merged in levels of fan_in: keys, rank, vec_id, score."""
    while parts > fan_in:
        lists, parts = lists.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")), -(-parts // fan_in)
        lists = merged(lists, k, "part", keys).drop("rank")
    return merged(lists, k, keys=keys).select(*keys, "rank", "vec_id", "score")
