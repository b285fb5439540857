"""An isolation forest as a table: trees grown on executors from samples of their own, and paths walked over their nodes.

Node 1 is a tree's root, 2k and 2k + 1 are the children of k. What is random comes from digests: the sample of a tree are
the rows with the least digests of key and tree; a node's column and cut come from that of tree and node. So trees do not
depend on how rows are dealt, and other engines can grow the same ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

TREES, SAMPLE = 100, 256
NODES = "tree int, node long, depth int, size int, column int, cut double"
#: Hexadecimal digits of a digest that make a number from 0 to 1.
DIGITS = 13


def mean_depth(n: float) -> float:
    """The mean depth of a random search tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def digest(key: Column, tree: Column) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), tree.cast("string")).cast("binary"))


def samples(df: DataFrame, vector: str, key: str, trees: int = TREES, size: int = SAMPLE) -> DataFrame:
    """(tree, vec): the size rows of each tree with the least digests.

    Rows whose digest cannot be among them (the bound is 8 deviations above the expected number) are left out before the
    shuffle, so that it holds about 1.5 rows for each one that is kept, however many rows there are.
    """
    rows = df.where(F.col(vector).isNotNull())
    share = min(1.0, (size + 8 * size**0.5) / max(1, rows.count()))
    bound = "%0*x" % (DIGITS, int(share * 16**DIGITS)) if share < 1 else "g"
    known = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), digest(F.col(key), t).alias("digest")))
    near = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"), F.explode(F.filter(known, lambda x: x["digest"] < bound)).alias("x"))
    by = Window.partitionBy("tree").orderBy("digest", "key")
    return near.select("key", "vec", "x.*").withColumn("place", F.row_number().over(by)).where(F.col("place") <= size).select("tree", "vec")


def draws(tree: int, node: int) -> tuple[float, float]:
    """Two numbers from 0 to 1."""
    text = hashlib.md5(f"{tree}:{node}".encode()).hexdigest()
    return int(text[:DIGITS], 16) / 16**DIGITS, int(text[DIGITS : 2 * DIGITS], 16) / 16**DIGITS


def grown(sample: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one tree; column and cut are null in leaves."""
    tree, rows = int(sample["tree"].iloc[0]), np.array(sample["vec"].tolist(), float)
    limit, out, open_ = int(np.ceil(np.log2(max(2, len(rows))))), [], [(1, 0, rows)]
    while open_:
        node, depth, own = open_.pop()
        low, high = own.min(axis=0), own.max(axis=0)
        spread = np.flatnonzero(high > low)
        if depth >= limit or not len(spread):
            out.append((tree, node, depth, len(own), None, None))
            continue
        first, second = draws(tree, node)
        column = int(spread[int(first * len(spread))])
        cut = low[column] + second * (high[column] - low[column])
        out.append((tree, node, depth, len(own), column, cut))
        below = own[:, column] < cut
        # a cut at the least value parts nothing off: an empty child is a leaf of no rows
        for child, part in ((2 * node, own[below]), (2 * node + 1, own[~below])):
            if len(part):
                open_.append((child, depth + 1, part))
            else:
                out.append((tree, child, depth + 1, 0, None, None))
    frame = pd.DataFrame(out, columns=["tree", "node", "depth", "size", "column", "cut"])
    return frame.astype({"column": "Int32", "cut": "Float64"})


def grow(df: DataFrame, vector: str, key: str, trees: int = TREES, size: int = SAMPLE) -> DataFrame:
    """The forest: tree, node, depth, size (rows of the sample in it), column and cut (null in leaves). At most trees * 4 * size rows."""
    return checkpointed(samples(df, vector, key, trees, size).groupBy("tree").applyInPandas(grown, NODES))


def walked(df: DataFrame, forest: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, tree, node): the leaf of each row in each tree, by joins, a level at a time."""
    nodes = F.broadcast(forest.select("tree", "node", "column", "cut"))  # bounded, see grow
    levels = forest.agg(F.max("depth")).first()[0] or 0
    trees = F.broadcast(forest.select("tree").distinct())
    at = df.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>").alias("vec")).crossJoin(trees).withColumn("node", F.lit(1).cast("long"))
    for _ in range(levels):
        child = 2 * F.col("node") + (F.get("vec", F.col("column")) >= F.col("cut")).cast("long")
        at = at.join(nodes, ["tree", "node"]).select(key, "vec", "tree", F.when(F.col("column").isNull(), F.col("node")).otherwise(child).alias("node"))
    return at.select(key, "tree", "node")


def path_lengths(df: DataFrame, forest: DataFrame, vector: str, out: str = "path_length") -> DataFrame:
    """df with the mean over trees of a row's leaf's depth, plus the mean depth of a tree of the leaf's rows.

    The forest's rows (a bounded number) go to all executors as arrays; rows pass them in Arrow batches.
    """
    table = forest.toPandas()
    if not len(table):
        return df.withColumn(out, F.lit(0.0))
    trees, last = int(table["tree"].max()) + 1, int(table["node"].max()) + 1
    column, cut, length = np.full((trees, last), -1, np.int32), np.zeros((trees, last)), np.zeros((trees, last))
    place = table["tree"].to_numpy(), table["node"].to_numpy()
    column[place], cut[place] = table["column"].fillna(-1).to_numpy(int), table["cut"].fillna(0).to_numpy(float)
    length[place] = [d + mean_depth(n) for d, n in zip(table["depth"], table["size"], strict=True)]
    known, levels = sorted(set(table["tree"].tolist())), int(table["depth"].max())
    sent = df.sparkSession.sparkContext.broadcast((column, cut, length))

    def mean(rows: np.ndarray) -> np.ndarray:
        column, cut, length = sent.value
        total, own = np.zeros(len(rows)), np.arange(len(rows))
        for tree in known:
            node = np.ones(len(rows), np.int64)
            for _ in range(levels):
                c = column[tree, node]
                node = np.where(c < 0, node, 2 * node + (rows[own, c] >= cut[tree, node]))
            total += length[tree, node]
        return total / len(known)

    @F.pandas_udf("double")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            has = batch.notna().to_numpy()
            value = np.full(len(batch), np.nan)
            if has.any():
                value[has] = mean(np.array(batch[has].tolist(), float))
            yield pd.Series(value).where(has, None).astype("Float64")

    return df.withColumn(out, walk(F.col(vector).cast("array<double>")))


def isolation_scores(df: DataFrame, vector: str = "scaled", key: str = "user", trees: int = TREES, size: int = SAMPLE, out: str = "iso_forest_score") -> DataFrame:
    """Isolation-forest scores, higher for more unusual rows; null for null vectors, 0 where no row has one."""
    forest = grow(df, vector, key, trees, size)
    n = forest.where("node = 1").agg(F.max("size")).first()[0]
    if n is None:
        return df.withColumn(out, F.lit(0.0))
    scored = path_lengths(df, forest, vector, "__path")
    return scored.withColumn(out, F.pow(F.lit(2.0), -F.col("__path") / max(mean_depth(n), 1e-9)) - 0.5).drop("__path")
