"""Hard-negative mining by Strassen products of anchor and candidate tiles.

Candidates are dealt by hash to shards, as in the exact search; every anchor visits every shard, and a shard's anchors
stream past it in tiles of at most TILE_CELLS scores. A tile's scores are one matrix product of 64-bit integers by
Strassen's recursion: both sides are padded with zeros to even sizes and halved until a side is no longer than LEAF,
where rows meet columns plainly. Additions, subtractions and products of integers are exact, so the scores are.

The first round keeps, for each anchor and shard, a heap of the best rows of the anchor's label; the heaps merge in a
tree to its positives. The second round gives every anchor its positives' scores along and keeps, for each positive, a
heap of the best rows of other labels whose score lies in the positive's window; these merge in the same way. A heap is
a list of at most k rows, so what travels does not grow with a label's rows.

Vectors are of integers: floor(scale * x); sums beyond 64 bits are not defined.

Defined results: rows without an id or label, and vectors null, empty, or with null or non-finite components take no
part; an id in several rows counts once (its least label, then vector); anchors meet only rows of their own dimension;
ties go to smaller ids; an anchor without positives, and a positive without negatives, has no rows; a positive of a
negative score has an empty window; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import finite, merge_tree

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: The window of a negative's score, in percent of the positive's.
LOW, HIGH = 30, 90
SHARD_ROWS, SHARD_BYTES = 4096, 32 << 20
TILE_CELLS = 1 << 20
LEAF = 32


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices by seven products of their quarters."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.zeros((2 * m, 2 * n), np.int64)
    c11, c12, c21, c22 = out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:]
    # each product goes to the quarters it is part of, so that one is held at a time
    p = strassen(a11 + a22, b11 + b22)
    c11 += p
    c22 += p
    p = strassen(a21 + a22, b11)
    c21 += p
    c22 -= p
    p = strassen(a11, b12 - b22)
    c12 += p
    c22 += p
    p = strassen(a22, b21 - b11)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12)
    c11 += strassen(a12 - a22, b21 + b22)
    return out


def best(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest valid scores of each row; ties go to smaller columns."""
    if k < scores.shape[1]:
        held = np.where(valid, scores, np.iinfo(np.int64).min)
        valid = valid & (held >= np.partition(held, -k, axis=1)[:, [-k]])
    row, column = np.nonzero(valid)
    order = np.lexsort((-scores[row, column], row))  # stable, and columns ascend
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def labelled(vectors: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, with vectors of integers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("vec"))
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("row"))
    return once.select("vec_id", "row.label", F.transform("row.vec", lambda x: F.floor(x * scale).cast("long")).alias("vec"))


def met(rows: DataFrame, anchors: DataFrame, shards: int, tile_of, schema: str) -> DataFrame:
    """tile_of's frames for every shard of rows and tile of anchors (vec_id, label, vec, goals) of one dimension."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    goals = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    candidates = rows.select(part.alias("part"), F.size("vec").alias("dim"), F.lit(0).alias("kind"), "vec_id", "label", "vec", goals.alias("goals"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asking = anchors.select(everywhere.alias("part"), F.size("vec").alias("dim"), F.lit(1).alias("kind"), "vec_id", "label", "vec", "goals")
    dealt = candidates.unionByName(asking).repartition(shards, "part").sortWithinPartitions("part", "dim", "kind", "vec_id")

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, shard, ids, labels = None, [], None, None, None
        for batch in batches:
            for (part, dim), own in batch.groupby(["part", "dim"], sort=False):
                if (part, dim) != now:
                    now, parts, shard = (part, dim), [], None
                of_shard = own[own["kind"] == 0]
                if len(of_shard):
                    parts.append((np.array(of_shard["vec"].tolist(), np.int64), of_shard["vec_id"].to_numpy(), of_shard["label"].to_numpy()))
                asking = own[own["kind"] == 1]
                if not len(asking) or not parts:
                    continue
                if shard is None:
                    vecs, ids, labels = (np.concatenate(x) for x in zip(*parts, strict=True))
                    shard, parts = np.ascontiguousarray(vecs.T), [None]
                rows_ = max(1, TILE_CELLS // len(ids))
                for a in range(0, len(asking), rows_):
                    some = asking[a : a + rows_]
                    scores = strassen(np.array(some["vec"].tolist(), np.int64), shard)
                    yield tile_of(some, scores, ids, labels).assign(part=np.int32(part))

    return dealt.mapInPandas(tiles, schema)


def positives_of(some: pd.DataFrame, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> pd.DataFrame:
    anchor = some["vec_id"].to_numpy()
    row, column = best(scores, (some["label"].to_numpy()[:, None] == labels) & (anchor[:, None] != ids), k)
    return pd.DataFrame({"query_id": anchor[row], "vec_id": ids[column], "score": scores[row, column]})


def negatives_of(some: pd.DataFrame, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int, low: int, high: int) -> pd.DataFrame:
    anchor, other = some["vec_id"].to_numpy(), some["label"].to_numpy()[:, None] != labels
    goals, out = some["goals"].tolist(), []
    for place in range(max(map(len, goals))):
        has = np.array([place < len(g) for g in goals])
        goal = [g[place] if place < len(g) else {"id": 0, "score": 0} for g in goals]
        wins = [int(g["score"]) for g in goal]
        least = np.array([max(-(2**63), -(-low * s // 100)) for s in wins])[:, None]
        most = np.array([min(2**63 - 1, high * s // 100) for s in wins])[:, None]
        row, column = best(scores, other & has[:, None] & (scores >= least) & (scores <= most), k)
        out.append(
            pd.DataFrame(
                {
                    "query_id": anchor[row], "positive_id": np.array([g["id"] for g in goal], np.int64)[row], "positive_score": np.array(wins, np.int64)[row],
                    "vec_id": ids[column], "score": scores[row, column],
                }
            )
        )
    return pd.concat(out)


def mine(
    vectors: DataFrame, anchor_divisor: int, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shard_rows: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose id anchor_divisor divides. label: an expression to use in place of label_col.
    """
    rows = labelled(vectors, id_col, vec_col, F.col(label_col) if label is None else label, scale)
    known = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("dim")).first()
    if shard_rows is None:
        most = SHARD_BYTES // (8 * max(1, known["dim"] or 1))
        shard_rows = max(1, min(most, max(SHARD_ROWS, -(-known["n"] // vectors.sparkSession.sparkContext.defaultParallelism))))
    shards = max(1, -(-known["n"] // shard_rows))
    anchors = rows.where(F.col("vec_id") % anchor_divisor == 0)
    no_goals = F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("goals")
    near = met(rows, anchors.select("*", no_goals), shards, lambda *x: positives_of(*x, positives), "query_id long, vec_id long, score long, part int")
    found = merge_tree(near, positives, shards)
    goals = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("ranked"))
    goals = goals.select(F.col("query_id").alias("vec_id"), F.transform("ranked", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("goals"))
    schema = "query_id long, positive_id long, positive_score long, vec_id long, score long, part int"
    far = met(rows, anchors.join(goals, "vec_id"), shards, lambda *x: negatives_of(*x, negatives, low, high), schema)
    kept = merge_tree(far, negatives, shards, keys=("query_id", "positive_id", "positive_score"))
    return kept.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
