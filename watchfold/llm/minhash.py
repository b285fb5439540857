"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of lower-cased words, as 64-bit hashes. Its sketch has BANDS * ROWS bins.
In round i every shingle is placed in a hashed bin with a hashed fraction, and the bin keeps the least of
i + fraction; rounds end when all bins are filled. After as many rounds as bins, each further round puts every shingle
into one bin of its own, so that every bin fills. Each bin then agrees for two sets with the probability of their
similarity, with the concentration of independent samples, at a cost near that of one pass over the set.

Documents with equal sets are one class from the start. Classes that agree in a whole band of ROWS bins meet in a
bucket. In a bucket all classes are compared with a pivot, the one with the least shingles of its own. Those that are
then in one component need no further comparison; in buckets that still hold several, what is not in the first meets
all that is in another. So a bucket of many copies costs its length, not its square, and no pair is dropped: a pair is
passed over only if it is connected already, or if the shingles that either shares with any other class are too few for
the similarity asked for. Every comparison is exact, on full sets.

At a similarity of 0.8 a pair shares no band with probability (1 - 0.8 ** 5) ** 32 = 3e-6.

Defined results: a text of fewer words than a shingle has one, of all its words; null texts and texts without words
have an empty set and are linked with nothing (component_id is their own doc_id); repeated rows are copies of each
other; a null doc_id never names a component unless all of it is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, discard, sent, small_batches, stored, text_key
from .components import components

BANDS, ROWS = 32, 5
#: Sets that a task holds at once, and that it streams past them, when what is left of a pivot's buckets is compared.
TILE, BLOCK = 1024, 4096
#: Words whose hashes a task keeps.
CACHE = 500_000
GOLDEN = 0x9E3779B97F4A7C15
WIDTH = 2
PERCENT = 80


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int, hashes: Hashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    out = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(GOLDEN) + w[k : len(w) - width + 1 + k])
    return np.unique(out)


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The least round << 32 | fraction of each bin."""
    out = np.full(bins, 2**64 - 1, np.uint64)
    step, done = max(1, -(-6 * bins // len(shingles))), 0
    while done < bins and out.max() == 2**64 - 1:
        rounds = np.arange(done, min(bins, done + step), dtype=np.uint64)[:, None]
        h = mix(shingles[None, :] ^ mix((rounds + np.uint64(1)) * np.uint64(GOLDEN)))
        of = (h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
        np.minimum.at(out, of.ravel().astype(np.intp), (h & np.uint64(0xFFFFFFFF) | rounds << np.uint64(32)).ravel())
        done += step
    for b in np.flatnonzero(out == 2**64 - 1):
        h = mix(shingles ^ mix(np.array([bins + b + 1], np.uint64) * np.uint64(GOLDEN)))
        out[b] = (h & np.uint64(0xFFFFFFFF)).min() | np.uint64(bins + b) << np.uint64(32)
    return out


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text key, n (size of the set), f1 and f2 (128 bits that identify the set) and bands (a hash of each)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            sets = [shingle_set(t, width, hashes) for t in batch.pop("text")]
            print_ = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            full = np.array([len(s) > 0 for s in sets], bool)
            sketches = np.array([sketch(s, bands * rows) for s in sets if len(s)], np.uint64).reshape(-1, bands, rows)
            h = np.broadcast_to(np.arange(bands, dtype=np.uint64), sketches.shape[:2])
            for k in range(rows):
                h = mix(h * np.uint64(GOLDEN) + sketches[:, :, k])
            of = np.empty(len(sets), object)
            for k, own in zip(np.flatnonzero(full), h.view(np.int64), strict=True):
                of[k] = own
            batch["n"] = [len(s) for s in sets]
            batch["f1"] = np.array([p & (2**64 - 1) for p in print_], np.uint64).view(np.int64)
            batch["f2"] = np.array([p >> 64 for p in print_], np.uint64).view(np.int64)
            batch["bands"] = of
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch[["doc_id", "th1", "th2", "n", "f1", "f2", "bands"]]

    keyed = docs.select("doc_id", "text", *text_key(F.col("text")))
    return keyed.mapInPandas(sign, "doc_id long, th1 long, th2 long, n long, f1 long, f2 long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, set) for wanted (node, th1, th2); set has the sorted hashes as bytes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "set": [shingle_set(t, width, hashes).tobytes() for t in batch["text"]]})

    # where the wanted texts are few, the others do not travel
    keyed = docs.where("text IS NOT NULL").select(*text_key(F.col("text")), "text").join(sent(wanted.select("th1", "th2"), 48), ["th1", "th2"], "left_semi")
    texts = keyed.groupBy("th1", "th2").agg(F.first("text").alias("text"))
    return texts.join(wanted, ["th1", "th2"]).select("node", "text").mapInPandas(make, "node long, set binary")


@F.pandas_udf(T.LongType())
def shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sets."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with common, the size of their intersection, and alike: percent * union <= 100 * common."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    na, nb, common = F.length("set_a") / 8, F.length("set_b") / 8, F.col("common")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("common", shared("set_a", "set_b"))
    return both.select("a", "b", "common", (100 * common >= percent * (na + nb - common)).alias("alike"))


def occurrences(sets: DataFrame) -> DataFrame:
    """(node, n, c): the size of each set, and how many of its shingles are in any other set too."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                own = batch[a : a + 500]
                parts = [np.frombuffer(x, np.int64) for x in own["set"]]
                yield pd.DataFrame({"shingle": np.concatenate(parts), "node": np.repeat(own["node"].to_numpy(), [len(x) for x in parts])})

    alone = sets.mapInPandas(spread, "shingle long, node long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    lone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    return sets.select("node", (F.length("set") / 8).cast("long").alias("n")).join(lone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("c"))


def can_link(percent: int, n: str, c: str, n2: str, c2: str):
    """Whether two sets may be alike enough: what they share is no more than what either shares with any other set."""
    return (100 + percent) * F.least(F.col(c), F.col(c2)) >= percent * (F.col(n) + F.col(n2))


class Tile:
    """Sets of one tile as an inverted index, which yields the intersections of a set with all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        self.owner, self.sizes = owner[order], np.array([len(x) for x in sets])
        self.shingles, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))

    def alike(self, other: np.ndarray, percent: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.shingles, other), len(self.shingles) - 1)
        at = at[self.shingles[at] == other]
        sizes = self.ends[at] - self.starts[at]
        places = np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        common = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(other) - common))


def settled(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, of all classes of a pivot's buckets with those outside the buckets' first components.

    rest: bucket, pivot, node, component and first, of buckets with several components. Both sides are dealt in blocks;
    a task holds one block of the lesser side and streams one of the other past it. It yields no more links than
    it takes to join what it found alike.
    """
    members = rest.select("pivot", "node", "component").distinct()
    others = rest.where("component != first").select("pivot", "node", "component").distinct()
    sizes = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ys"))
    sizes = sizes.join(others.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("xs")), "pivot")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = others.join(sizes, "pivot").select("pivot", block("xs").alias("x"), every("ys").alias("y"), F.lit(0).alias("kind"), "node", "component")
    right = members.join(sizes, "pivot").select("pivot", every("xs").alias("x"), block("ys").alias("y"), F.lit(1).alias("kind"), "node", "component")
    dealt = left.unionByName(right).join(sets, "node").repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y", "kind", "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, tile, joined = None, [], None, {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for batch in batches:
            found = []
            for pivot, x, y, kind, node, component, data in zip(*(batch[c] for c in ("pivot", "x", "y", "kind", "node", "component", "set")), strict=True):
                if (pivot, x, y) != now:
                    now, held, tile, joined = (pivot, x, y), [], None, {}
                own = np.frombuffer(data, np.uint64)
                if kind == 0:
                    held.append((node, component, own))
                    continue
                tile = tile or Tile([h[2] for h in held])
                for k in tile.alike(own, percent):
                    one, two = root(held[k][1]), root(component)
                    if one != two:
                        joined[max(one, two)] = min(one, two)
                        found.append((held[k][0], node))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return dealt.select("pivot", "x", "y", "kind", "node", "component", "set").mapInPandas(compare, "a long, b long")


def linked(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the classes with links. classes: node, th1, th2, bands.

    What has a row for each class and band is kept as Parquet, which takes a fraction of a checkpoint, until it is done with.
    """
    spark, folders = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, folder = stored(df, name)
        folders.append(folder)
        return df

    spread = classes.select("node", F.explode("bands").alias("bucket"))
    several = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    met = kept(spread.join(several, "bucket"), "met")
    wanted = checkpointed(met.select("node").distinct().join(classes.select("node", "th1", "th2"), "node"))
    sets = checkpointed(full_sets(docs, wanted, width))
    # nodes in a new order: those that share most of their shingles first, as they make the best pivots
    known = occurrences(sets).where(100 * F.col("c") >= percent * F.col("n")).withColumn("own", 1 - F.col("c") / F.col("n"))
    ranked = checkpointed(known.repartitionByRange("own", "node").sortWithinPartitions("own", "node").withColumn("id", F.monotonically_increasing_id()))
    members = kept(met.join(ranked, "node").select("bucket", F.col("id").alias("node")), "members")
    sets = sets.join(ranked.select("node", "id"), "node").select(F.col("id").alias("node"), "set")
    sizes = ranked.select("id", "n", "c")
    pivots = members.groupBy("bucket").agg(F.min("node").alias("a"))
    members = kept(members.join(pivots, "bucket"), "pivots")
    pairs = members.where("node != a").select("a", F.col("node").alias("b")).distinct()
    pairs = pairs.join(sizes.toDF("a", "na", "ca"), "a").join(sizes.toDF("b", "nb", "cb"), "b").where(can_link(percent, "na", "ca", "nb", "cb"))
    scored = checkpointed(measured(pairs, sets, percent))
    links = scored.where("alike").select("a", "b")
    labels = components(links)
    # what is not in its bucket's first component meets all that is in another
    named = kept(members.join(labels, "node", "left").select("bucket", F.col("a").alias("pivot"), "node", F.coalesce("component", "node").alias("component")), "named")
    first = named.groupBy("bucket").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last").drop("last")
    more = checkpointed(settled(named.join(first, "bucket"), sets, percent))
    if not more.isEmpty():
        # from the stars there are, not from all links again
        stars = labels.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = components(stars.unionByName(more))
    for folder in folders:
        discard(spark, folder)
    return labels.join(ranked.select(F.col("node").alias("class"), "id"), F.col("node") == F.col("id")).select(F.col("class").alias("node"), "component")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, th1, th2, n_shingles, component_id, and lead: whether the row comes first of its component."""
    small_batches(docs.sparkSession)
    signed = checkpointed(signatures(docs, width, bands, rows))
    classes = signed.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("th1", "th2")).alias("th"), F.first("bands").alias("bands"))
    classes = checkpointed(classes.select("f1", "f2", "th.th1", "th.th2", "bands", F.monotonically_increasing_id().alias("node")))
    labels = linked(docs, classes, width, percent)
    # components are named by ids of the linked classes; other classes by their own, below 0
    component = classes.select("f1", "f2", "node").join(labels, "node", "left").select("f1", "f2", F.coalesce("component", -F.col("node") - 1).alias("component"))
    rows_ = signed.drop("bands").join(component, ["f1", "f2"], "left")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th1", "th2")
    firsts = rows_.where("component IS NOT NULL").groupBy("component").agg(F.min(place).alias("first"))
    lead = F.col("first").isNull() | (F.col("first") == place)
    return rows_.join(firsts, "component", "left").select(
        "doc_id", "th1", "th2", F.col("n").alias("n_shingles"), F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), lead.alias("lead")
    )


def dedup_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, **options) -> DataFrame:
    """docs with one document of each component; of rows that agree in doc_id and text one stays. Empty sets all stay."""
    found = near_duplicates(docs, width, percent, **options)
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id")]
    leads = found.where("lead").select(*key, "th1", "th2", (F.col("n_shingles") > 0).alias("full")).distinct()
    rows_ = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key, *text_key(F.col("text")))
    stay = rows_.join(leads, ["no_id", "id", "th1", "th2"])
    turn = F.row_number().over(Window.partitionBy("no_id", "id", "th1", "th2").orderBy(F.lit(0)))
    return stay.withColumn("turn", turn).where("turn = 1 OR NOT full").select("row.*")
