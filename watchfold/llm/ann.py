"""Approximate nearest neighbours by a forest of random-projection trees.

Equal vectors are one entry of the index, with their k + 1 smallest ids, all that any answer can need of them. The trees
are fitted on a hash sample of about SAMPLE_PER_LEAF entries a leaf: each node projects on the difference of two random entries
and splits at the sample's median, down to leaves of about LEAF_ROWS entries. All entries are then filed into a leaf of each
tree, in parallel. Every table of more than LEAF_ROWS entries has its forest.

A query walks all trees through one priority queue, nearest side first by the sum of the squared margins crossed on the
way, and takes leaves until its budget is spent. Leaves meet their queries by subtree (about SUBTREE_ROWS entries, larger
ones in blocks), so that a query goes to a subtree once, with the leaves it visits there; only those are scored.
Candidates are ranked by exact inner products in doubles, and the lists merge. The first tree is scored before the
others: its k-th best score is a floor for each query, under which the others report nothing.

The budget is measured, not guessed: for PROBES queries the exact neighbours are found over all entries, and the
budget is the least number of leaves that holds TARGET of them. Inner products are searched as angles: entries get a
component that lifts them to the longest norm.

Bounds: the forest (trees * 2**depth nodes) takes no more than MAX_FOREST_BYTES, as it is broadcast, and the sample a
small multiple of that; from there on leaves grow instead.

Defined results: vectors null, zero, or with null or non-finite components take no part; queries meet only entries of
their own dimension, which has a forest of its own; an id in several rows counts once (its least vector); ties go to
smaller ids; with fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import merged, usable

TREES = 8
LEAF_ROWS = 64
SUBTREE_ROWS = 4096
SAMPLE_PER_LEAF = 16
TARGET = 0.95
PROBES = 64
MAX_FOREST_BYTES = 64 << 20
#: Candidates kept by rough scores beyond those asked for. Where ties go on behind them, all that tie are scored.
SLACK = 11
#: Queries that a task walks or scores at once.
CHUNK = 256
RESULT = "query_id long, vec_id long, score double"
EMPTY = "query_id long, rank int, vec_id long, score double"


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, depth: int, norm: float, seed: int = 11):
        self.depth, self.trees, self.norm = depth, trees, norm
        sample, rng = self.lifted(sample), np.random.default_rng(seed)
        self.planes = np.zeros((trees, 1 << depth, sample.shape[1]), np.float32)
        self.cuts = np.zeros((trees, 1 << depth), np.float32)
        for t in range(trees):
            groups = {1: np.arange(len(sample))}
            for node in range(1, 1 << depth):
                own = groups.pop(node)
                pick = rng.choice(own, 2, replace=False) if len(own) > 1 else None
                plane = sample[pick[0]] - sample[pick[1]] if pick is not None else rng.normal(size=sample.shape[1])
                if not (length := np.linalg.norm(plane)):
                    plane, length = rng.normal(size=sample.shape[1]), 1.0
                self.planes[t, node] = plane / length
                at = sample[own].astype(np.float32) @ self.planes[t, node]
                self.cuts[t, node] = np.median(at) if len(own) else 0
                groups[2 * node], groups[2 * node + 1] = own[at <= self.cuts[t, node]], own[at > self.cuts[t, node]]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each entry in each tree, as tree << depth | leaf."""
        x = self.lifted(x).astype(np.float32)
        node = np.ones((self.trees, len(x)), np.int64)
        for t in range(self.trees):
            for _ in range(self.depth):
                node[t] = 2 * node[t] + (np.einsum("nd,nd->n", x, self.planes[t][node[t]]) > self.cuts[t][node[t]])
        return ((np.arange(self.trees) << self.depth)[:, None] | (node - (1 << self.depth))).T

    def visits(self, queries: np.ndarray, budget: int) -> list[list[int]]:
        """For each query the first leaves off the shared queue."""
        out, end, flat = [], 1 << self.depth, self.planes.reshape(-1, self.planes.shape[2])[:, : queries.shape[1]]
        for at in queries.astype(np.float32) @ flat.T - self.cuts.reshape(-1):
            margins = at.reshape(self.trees, end).tolist()
            queue, found = [(0.0, t, 1) for t in range(self.trees)], []
            while queue and len(found) < budget:
                far, t, node = heapq.heappop(queue)
                while node < end:
                    margin = margins[t][node]
                    near = 2 * node + (margin > 0)
                    heapq.heappush(queue, (far + margin * margin, t, near ^ 1))
                    node = near
                found.append(t << self.depth | node - end)
            out.append(found)
        return out


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float)


class Entries:
    """Entries that a task holds, with their lists of ids, and with the leaf of each if they are in order of leaves."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], leaves: np.ndarray | None = None):
        self.vectors, self.flat = vectors, np.concatenate(ids)
        self.sizes = np.array([len(x) for x in ids])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.leaves = leaves
        self.longest = float(np.sqrt((vectors * vectors).sum(axis=1).max()))

    def spans(self, asked: list[np.ndarray] | None, number: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """Queries (by place) with the stretch of entries that they visit; all visit all unless told which leaves."""
        if asked is None:
            for a in range(0, len(self.vectors), SUBTREE_ROWS):
                yield np.arange(number), a, min(a + SUBTREE_ROWS, len(self.vectors))
            return
        query, leaf = np.repeat(np.arange(number), [len(x) for x in asked]), np.concatenate(asked)
        order = np.argsort(leaf, kind="stable")
        names, at = np.unique(leaf[order], return_index=True)
        for name, own in zip(names, np.split(query[order], at[1:]), strict=True):
            a, b = np.searchsorted(self.leaves, [name, name + 1])
            if a < b:
                yield own, int(a), int(b)

    def best(self, names: np.ndarray, queries: np.ndarray, k: int, asked: list[np.ndarray] | None = None, floors: np.ndarray | None = None) -> pd.DataFrame:
        """The k best ids of each query among the entries it visits, down to its floor: by rough scores first, then by exact ones."""
        number, take = len(queries), k + 1 + SLACK
        score, place = np.full((number, take), -np.inf), np.full((number, take), -1)
        spans = list(self.spans(asked, number))
        for own, a, b in spans:
            s = np.hstack([score[own], queries[own] @ self.vectors[a:b].T])
            p = np.hstack([place[own], np.broadcast_to(np.arange(a, b), (len(own), b - a))])
            top = np.argpartition(-s, take - 1, axis=1)[:, :take]
            score[own], place[own] = np.take_along_axis(s, top, axis=1), np.take_along_axis(p, top, axis=1)
        # rough scores that differ by less than this may belong to equal exact ones
        near = 1e-9 * np.sqrt((queries * queries).sum(axis=1)) * self.longest
        least = -np.partition(-score, k, axis=1)[:, k] - near
        tied = np.isfinite(least) & (score.min(axis=1) >= least)
        place[tied] = -1
        query, column = np.nonzero(place >= 0)
        found = [(query, place[query, column])]
        for own, a, b in spans if tied.any() else ():
            own = own[tied[own]]
            q, e = np.nonzero(queries[own] @ self.vectors[a:b].T >= least[own, None])
            found.append((own[q], e + a))
        query, entry = (np.concatenate(x) for x in zip(*found, strict=True))
        exact = np.empty(len(query))
        for a in range(0, len(query), 4096):
            exact[a : a + 4096] = np.einsum("pd,pd->p", queries[query[a : a + 4096]], self.vectors[entry[a : a + 4096]])
        sizes = self.sizes[entry]
        ids = self.flat[np.repeat(self.starts[entry] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        query, exact = np.repeat(query, sizes), np.repeat(exact, sizes)
        other = ids != names[query]
        if floors is not None:
            other &= ~(exact < floors[query])
        query, exact, ids = query[other], exact[other], ids[other]
        order = np.lexsort((ids, -exact, query))
        query, exact, ids = query[order], exact[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < k
        return pd.DataFrame({"query_id": names[query[keep]].astype(np.int64), "vec_id": ids[keep].astype(np.int64), "score": exact[keep]})


def exact(entries: DataFrame, probes: pd.DataFrame, k: int) -> DataFrame:
    """The k nearest of a few queries over all entries, with the entries' vectors."""
    queries, names = matrix(probes["vec"]), probes["vec_id"].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                of = {i: v for own, v in zip(batch["ids"], batch["vec"], strict=True) for i in own}
                found = Entries(matrix(batch["vec"]), batch["ids"].tolist()).best(names, queries, k)
                yield found.assign(vec=found["vec_id"].map(of))

    return merged(entries.mapInPandas(scan, f"{RESULT}, vec array<double>"), k)


def budget_for(forest: Forest, entries: DataFrame, queries: DataFrame, number: int, k: int, target: float, probes: int) -> int:
    """The least number of leaves that holds the target share of the probes' exact neighbours."""
    everything = forest.trees << forest.depth
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, probes / max(1, number)) * (1 << 30))
    asked = queries.where(draw).limit(4 * probes).toPandas()
    if not len(asked):
        return everything
    truth = exact(entries, asked, k).toPandas()
    if not len(truth):
        return everything
    order = dict(zip(asked["vec_id"], forest.visits(matrix(asked["vec"]), everything), strict=True))
    place = {q: {leaf: n for n, leaf in enumerate(leaves)} for q, leaves in order.items()}
    needed = sorted(min(place[q][leaf] for leaf in own) for q, own in zip(truth["query_id"], forest.leaves(matrix(truth["vec"])).tolist(), strict=True))
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))] + 1


def search(
    vectors: DataFrame, query_divisor: int, k: int = 20, trees: int = TREES, leaf_rows: int = LEAF_ROWS, subtree_rows: int = SUBTREE_ROWS,
    target: float = TARGET, probes: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found of each vector whose id query_divisor divides."""
    rows = checkpointed(usable(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0)))
    out = vectors.sparkSession.createDataFrame([], EMPTY)
    for r in rows.select(F.size("vec").alias("dim")).distinct().orderBy("dim").collect():  # a row a dimension
        own = rows.where(F.size("vec") == r["dim"])
        out = out.unionByName(search_alike(own, query_divisor, k, trees, leaf_rows, subtree_rows, target, probes))
    return out


def search_alike(rows: DataFrame, query_divisor: int, k: int, trees: int, leaf_rows: int, subtree_rows: int, target: float, probes: int) -> DataFrame:
    """search() over rows (vec_id, vec) of one dimension."""
    turn = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    entries = checkpointed(rows.withColumn("turn", turn).where(F.col("turn") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = rows.where(F.col("vec_id") % query_divisor == 0)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    known = entries.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("norm"), F.max(F.size("vec")).alias("dim")).first()
    depth = max(0, int(np.ceil(np.log2(known["n"] / leaf_rows))))
    while depth and trees * (known["dim"] + 1) * 4 << depth > MAX_FOREST_BYTES:
        depth -= 1
    bits = max(0, depth - max(0, int(np.ceil(np.log2(known["n"] / subtree_rows)))))
    drawn = entries.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(min(1.0, (SAMPLE_PER_LEAF << depth) / known["n"]) * (1 << 30)))
    sample = matrix(drawn.select("vec").toPandas()["vec"]) if depth else np.zeros((0, known["dim"]))
    forest = Forest(sample.reshape(-1, known["dim"]), trees if depth else 1, depth, known["norm"])
    budget = budget_for(forest, entries, queries, queries.count(), k, target, probes)
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=list(shared.value.leaves(matrix(batch["vec"]))))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), CHUNK):
                own, made = batch[a : a + CHUNK], []
                for name, vec, leaves in zip(own["vec_id"], own["vec"], shared.value.visits(matrix(own["vec"]), budget), strict=True):
                    leaves = np.sort(np.array(leaves, np.int64))
                    subtrees, at = np.unique(leaves >> bits, return_index=True)
                    made += [(name, vec, s, x) for s, x in zip(subtrees, np.split(leaves, at[1:]), strict=True)]
                yield pd.DataFrame(made, columns=["query_id", "vec", "subtree", "asked"])

    filed = checkpointed(entries.mapInPandas(file, "vec array<double>, ids array<long>, leaf array<long>"))
    entry = filed.select("vec", "ids", F.explode("leaf").alias("leaf")).withColumn("subtree", F.shiftright("leaf", bits))
    sizes = entry.groupBy("subtree").agg(F.count(F.lit(1)).alias("n"))
    # of the subtrees, whose number the forest bounds, those that are dealt in blocks
    blocks = sizes.where(F.col("n") > 2 * subtree_rows).select("subtree", F.ceil(F.col("n") / subtree_rows).cast("int").alias("blocks"))
    entry = entry.join(F.broadcast(blocks), "subtree", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("vec"), F.col("blocks")), F.lit(0)).cast("long"))
    of_blocks = F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)).cast("long") - 1)
    query = queries.mapInPandas(walk, "query_id long, vec array<double>, subtree long, asked array<long>")
    query = query.join(F.broadcast(blocks), "subtree", "left").withColumn("block", F.explode(of_blocks))

    def met(own: DataFrame, asking: DataFrame) -> DataFrame:
        both = own.drop("blocks").unionByName(asking.drop("blocks"), allowMissingColumns=True)
        return both.repartition("subtree", "block").sortWithinPartitions("subtree", "block", F.col("query_id").asc_nulls_first(), "leaf").mapInPandas(rerank, RESULT)

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, held = None, [], None
        for batch in batches:
            for key, own in batch.groupby(["subtree", "block"], sort=False):
                if key != now:
                    now, parts, held = key, [], None
                filed_ = own["query_id"].isna()
                if filed_.any():
                    parts.append(own[filed_])
                asking = own[~filed_]
                if not len(asking) or not parts:
                    continue
                if held is None:
                    leaves = np.concatenate([p["leaf"].to_numpy(np.int64) for p in parts])
                    held = Entries(np.vstack([matrix(p["vec"]) for p in parts]), [i for p in parts for i in p["ids"]], leaves)
                for a in range(0, len(asking), CHUNK):
                    some = asking[a : a + CHUNK]
                    yield held.best(some["query_id"].to_numpy(np.int64), matrix(some["vec"]), k, some["asked"].tolist(), some["floor"].to_numpy(float))

    first = F.col("subtree") < 1 << (depth - bits)
    lists = checkpointed(merged(met(entry.where(first), query.where(first).withColumn("floor", F.lit(None).cast("double"))), k))
    if forest.trees > 1:
        floors = lists.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("floor"))
        others = met(entry.where(~first), query.where(~first).join(floors, "query_id", "left"))
        lists = lists.drop("rank").unionByName(others).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged(lists, k).select("query_id", "rank", "vec_id", "score")
