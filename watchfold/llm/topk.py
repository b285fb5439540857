"""Exact top-k search by tiled matrix products.

Candidates are dealt by hash to shards of about SHARD_BYTES, as a query is copied to each; where that makes fewer shards
than there are cores, to smaller ones, down to SHARD_ROWS vectors. Every query visits every shard, as the problem asks; a shard's
rows and the queries come to one task sorted, the shard first, and the queries stream past it in tiles of at most
TILE_CELLS scores (the more rows a shard has, the fewer queries a tile). Each tile is one matrix product with partial
selection of its k best. The shards' lists merge in a tree. A task holds one shard and one tile's scores, keys and
places, of 8 bytes a cell each, whatever the size of the table and the length of its vectors.

Vectors are of integers: floor(scale * x). Products are exact: tiles whose sums could pass 2**53 use integers, of 64
bits, instead of doubles (sums beyond 64 bits are not defined).

Defined results: vectors null, empty, or with null or non-finite components take no part; an id in several rows
counts once (its least vector); queries meet only candidates of their own dimension; ties go to smaller ids; with
fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import merge_tree, usable

SCALE = 1024
SHARD_ROWS, SHARD_BYTES = 4096, 32 << 20
TILE_CELLS = 1 << 20


def tile(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of each query; ids ascend."""
    exact = np.abs(queries).max() * np.abs(shard).max() * queries.shape[1] < 2.0**53
    scores = queries @ shard.T if exact else queries.astype(np.int64) @ shard.astype(np.int64).T
    # score and place in one number, so that ties go to smaller ids and selection needs no order
    least = scores.min()
    bits = int(len(ids) - 1).bit_length()
    if exact and float(scores.max() - least) < 2.0 ** (62 - bits):
        key = (scores - least).astype(np.int64)
        key <<= bits
        key |= np.arange(len(ids))[::-1]
        key[query_ids[:, None] == ids[None, :]] = -1
        top = min(k, len(ids))
        best = np.argpartition(key, len(ids) - top, axis=1)[:, len(ids) - top :]
        keep = np.take_along_axis(key, best, axis=1) >= 0
    else:
        best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, : k + 1]
        keep = ids[best] != query_ids[:, None]
        keep &= np.cumsum(keep, axis=1) <= k
    row, column = np.nonzero(keep)
    found = best[row, column]
    return pd.DataFrame({"query_id": query_ids[row], "vec_id": ids[found], "score": scores[row, found].astype(np.int64)})


def search(vectors: DataFrame, query_divisor: int, k: int = 10, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest integer inner products of each vector whose id query_divisor divides."""
    rows = usable(vectors, id_col, vec_col).select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec"))
    known = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("dim")).first()
    if shard_rows is None:
        most = SHARD_BYTES // (8 * max(1, known["dim"] or 1))
        shard_rows = max(SHARD_ROWS, min(most, -(-known["n"] // vectors.sparkSession.sparkContext.defaultParallelism)))
    shards = max(1, -(-known["n"] // shard_rows))
    candidates = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("part"), F.lit(0).alias("kind"), "vec_id", "vec")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part")
    queries = rows.where(F.col("vec_id") % query_divisor == 0).select(everywhere, F.lit(1).alias("kind"), "vec_id", "vec")
    dealt = candidates.unionByName(queries).withColumn("dim", F.size("vec")).repartition(shards, "part").sortWithinPartitions("part", "dim", "kind", "vec_id")

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, shard, ids = None, [], None, None
        for batch in batches:
            for (part, dim), own in batch.groupby(["part", "dim"], sort=False):
                if (part, dim) != now:
                    now, parts, shard = (part, dim), [], None
                of_shard = own[own["kind"] == 0]
                if len(of_shard):
                    parts.append((np.array(of_shard["vec"].tolist()), of_shard["vec_id"].to_numpy()))
                asking = own[own["kind"] == 1]
                if not len(asking) or not parts:
                    continue
                if shard is None:
                    shard, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
                    parts = [None]
                rows_ = max(1, TILE_CELLS // len(ids))
                for a in range(0, len(asking), rows_):
                    some = asking[a : a + rows_]
                    yield tile(np.array(some["vec"].tolist()), some["vec_id"].to_numpy(), shard, ids, k).assign(part=np.int32(part))

    found = dealt.mapInPandas(tiles, "query_id long, vec_id long, score long, part int")
    return merge_tree(found, k, shards)
