"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected the same number of times, target / source size. The expected copies are
summed along a fixed order of the source's documents, one offset is added, and a document is emitted once for each
integer that its stretch of the sum crosses. The order goes by the size's octave, then by a hash, so that the sample
keeps each source's mix of short and long documents and its words come near the target.

The prefix sum runs in cells of (source, octave, hash): a hot source is spread over thousands of cells, and only
the cells' totals are summed along the source.

Defined results: a null text has size 0 and counts as a document; a null source is a source of its own, ordered
last; documents that repeat are separate documents; a source of size 0 has target 0 and none of its documents is
taken; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, whole_row, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
CELL = ["src", "has_src", "octave", "salt"]


def offset(seed: int) -> float:
    """The random offset, in [0, 1), a multiple of 2**-20 so that sums with it stay exact."""
    return (zlib.crc32(str(seed).encode()) % 2**20) / 2**20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Each source's target, from rows (src, has_src, source_size): one row a source.

    Sources weigh by their place in code point order, null last. With the sources in the order of cap / weight, a
    source stops at its cap exactly if its share of what the earlier caps leave is no smaller than the cap.
    """
    place = Window.orderBy(F.desc("has_src"), "src")
    by_ratio = Window.orderBy("ratio", "place")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(place))
        .withColumn("w", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    )
    capped = (
        ranked.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("ratio") <= (F.col("total") - F.col("before")).cast("double") / F.col("w_left"))
    )
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    w_open = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    return capped.select(
        "src", "has_src", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left.cast("double") * F.col("w") / w_open).alias("target"),
    )


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """Rows (row, doc_id, source, size, tie) with source_size, target and copies."""
    cells = rows.select(
        "row", "doc_id", "size", "tie",
        F.coalesce("source", F.lit("")).alias("src"),
        F.col("source").isNotNull().alias("has_src"),
        F.length(F.bin("size")).alias("octave"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2).alias("salt"),
    )
    totals = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    along = Window.partitionBy("src", "has_src").orderBy("octave", "salt")
    targets = source_targets(totals.groupBy("src", "has_src").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    starts = totals.select(*CELL, (F.sum("n").over(along) - F.col("n")).alias("start")).join(targets, ["src", "has_src"])
    within = Window.partitionBy(*CELL).orderBy("size", "doc_id", "tie")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda k: F.floor(k.cast("double") * F.col("rate") + F.lit(offset(seed)))
    place = F.col("start") + F.col("rn")
    return (
        cells.withColumn("rn", F.row_number().over(within))
        .join(starts, CELL)
        .withColumn("rate", rate)
        .withColumn("copies", crossed(place) - crossed(place - 1))
        .select("row", "doc_id", "size", "source_size", "target", "copies")
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target and taken (the words the mix takes of it)."""
    # words are counted once, as the plan needs sizes several times
    rows = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(0).alias("tie"), F.lit(0).alias("row")))
    plan = plan_mix(rows, **options)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of docs."""
    rows = docs.select(
        whole_row(docs), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")
    )
    plan = plan_mix(rows, **options).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: The same in DuckDB's SQL, over a relation docs(doc_id, text, source).
REPORT_SQL = f"""
sized AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NOT NULL AS has_src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM docs),
cells AS (
  SELECT *, length(bin(size)) AS octave, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS salt FROM sized),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY src, has_src ORDER BY octave, salt, size, doc_id) AS k FROM cells),
sources AS (
  SELECT src, has_src, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY has_src DESC, src) AS place FROM sized GROUP BY src, has_src),
weighed AS (
  SELECT *, list_extract([{", ".join(map(str, WEIGHTS))}], (place - 1) % {len(WEIGHTS)} + 1) AS w,
         source_size * {MAX_REPEATS} AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
ratios AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM weighed),
filled AS (
  SELECT *, ratio <= CAST(total - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS capped FROM ratios),
targets AS (
  SELECT src, has_src, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(total - coalesce(sum(cap) FILTER (capped) OVER (), 0) AS DOUBLE) * w / CAST(sum(w) FILTER (NOT capped) OVER () AS BIGINT) END AS target
  FROM filled),
rated AS (
  SELECT doc_id, size, source_size, target, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM placed JOIN targets USING (src, has_src)),
mixed AS (
  SELECT doc_id, size, source_size, target,
         CAST(floor(k * rate + {offset(SEED)!r}) - floor((k - 1) * rate + {offset(SEED)!r}) AS BIGINT) AS copies FROM rated)
"""
