"""Joining, filling, reshaping and deduplicating feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows up to which a dimension is sent to all executors.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more rows than that; it counts at most so many. Otherwise Spark decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def merge(frames: list[DataFrame], keys: list[str], how: str = "full_outer") -> DataFrame:
    """Frames joined on keys, which a full join keeps from either side."""
    return reduce(lambda a, b: a.join(b, keys, how), frames)


def stacked(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """What a full join on keys gives, for frames with one row a key and no other column in common: a union and one aggregation."""
    all_ = diagonal(frames)
    return all_.groupBy(*keys).agg(*[F.max(c).alias(c) for c in all_.columns if c not in keys])


def left_without_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that takes from b only the columns a does not have."""
    return a.join(b.select(*keys, *[c for c in b.columns if c not in a.columns]), keys, "left")


def numbers(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, kind in df.dtypes if (kind in kinds or kind.startswith("decimal")) and c not in without]


def filled(df: DataFrame, keys: tuple[str, ...] = ("user", "date")) -> DataFrame:
    """0 for missing numbers; doubles stay doubles."""
    return df.fillna(0, numbers(df, keys))


def suffixed(df: DataFrame, suffix: str, keys: tuple[str, ...] = ("user", "date")) -> DataFrame:
    """The suffix behind each column but the keys, once."""
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in df.columns if c not in keys and not c.endswith(f"_{suffix}")})


def repeated_for(df: DataFrame, columns: list[str], suffixes: list[str]) -> DataFrame:
    """Columns that do not change, under each window's name."""
    return df.select("*", *[F.col(c).alias(f"{c}_{s}") for c in columns for s in suffixes])


def pivoted(df: DataFrame, keys: list[str], column: str, values: list, prefix: str) -> DataFrame:
    """Counts of each value as columns, 0 where there are none."""
    wide = df.groupBy(*keys).pivot(column, values).agg(F.count(F.lit(1)))
    return wide.withColumnsRenamed({str(v): f"{prefix}_{v}" for v in values}).fillna(0)


def median_imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's missing values become its median."""
    full = df
    for c in columns:
        full = full.crossJoin(F.broadcast(median(df, c).withColumnRenamed("median", f"{c}__median")))  # one row
    return full.select(*[F.coalesce(c, f"{c}__median").alias(c) if c in columns else F.col(c) for c in df.columns])


def median(df: DataFrame, column: str) -> DataFrame:
    """One row with the exact median of a column: its values counted, the distinct ones numbered across range partitions."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = checkpointed(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.sum("n").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = sizes.withColumn("before", before).withColumn("all", F.sum("size").over(Window.partitionBy()))
    within = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    middles = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    # only the partitions that hold a middle place are sorted
    near = placed.join(F.broadcast(starts.where((F.col("before") <= middles[1]) & (F.col("before") + F.col("size") > middles[0]))), "part")
    upto = near.withColumn("upto", F.col("before") + F.sum("n").over(within))
    hit = lambda m: F.max(F.when((F.col("upto") - F.col("n") <= m) & (F.col("upto") > m), F.col("value").cast("double")))
    return upto.agg(((hit(middles[0]) + hit(middles[1])) / 2).alias("median"))


def without_zero_columns(df: DataFrame, share: float = 0.95, keep: tuple[str, ...] = ("user", "date")) -> DataFrame:
    """Drops numeric columns of which more than a share is 0. Runs one aggregation."""
    columns = numbers(df, keep)
    if not columns:
        return df
    zeros = df.agg(*[F.avg((F.col(c) == 0).cast("double")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if zeros[c] is not None and zeros[c] > share])


def without_nan(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def select_by(df: DataFrame, suffixes: tuple[str, ...] = (), kinds: tuple[str, ...] = ()) -> list[str]:
    """Names of columns by suffix or type."""
    return [c for c, kind in df.dtypes if c.endswith(suffixes) and suffixes or kind in kinds]


def latest(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each key's row of the greatest order, nulls in it kept; ties go to the greatest row."""
    best = F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("row")
    return df.groupBy(key).agg(best).select(key, "row.*")


def latest_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key (or of all, without keys) in an order."""
    if not key:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rn") <= k)


def diagonal(frames: list[DataFrame]) -> DataFrame:
    """A union over all columns; those that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_keys(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select(*keys).distinct() for f in frames]).distinct()


def row_set(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """Distinct rows of a's columns: in either (union), in both (intersection), in a alone (difference), or in just one (either). Nulls equal nulls."""
    b = b.select(a.columns)
    if kind == "union":
        return a.unionByName(b).distinct()
    if kind == "intersection":
        return a.intersect(b)
    if kind == "difference":
        return a.subtract(b)
    if kind == "either":
        sides = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(2)))
        return sides.groupBy(*a.columns).agg(F.countDistinct("__side").alias("__sides")).where("__sides = 1").drop("__sides")
    raise ValueError(f"no such kind of set: {kind}")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in an order."""
    return latest_k(df, keys, order, 1).drop("rn")


def min_max(df: DataFrame, columns: list[str], epsilon: float = 1e-8) -> DataFrame:
    """Each column moved to 0..1 over all rows, as <column>_norm."""
    ends = df.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    full = df.crossJoin(F.broadcast(ends))  # one row
    return full.select(*df.columns, *[((F.col(c) - F.col(f"{c}__min")) / (F.col(f"{c}__max") - F.col(f"{c}__min") + epsilon)).alias(f"{c}_norm") for c in columns])


def rank_percentile(df: DataFrame, column: str, tie: str, name: str = "rank_percentile") -> DataFrame:
    """Place by column over the number of rows. Partitions of a range sort are numbered and then offset, so no task sees all rows."""
    ordered = df.repartitionByRange(column, tie).sortWithinPartitions(column, tie)
    placed = checkpointed(ordered.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("__before", before).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    place = F.col("__before") + F.col("__id") - F.col("__first")
    return placed.join(F.broadcast(starts), "__part").withColumn(name, place / F.col("__all")).drop("__part", "__id", "__n", "__first", "__before", "__all")
