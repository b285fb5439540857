"""The operators' queries, with production parameters over whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ann, decontaminate, langid, linededup, minhash, mining, mixing, packing, pii, quotes, topk, urls, variants
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return run


@query
def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents")).select("row.doc_id", "text", "n_entities")


@query
def op2_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


SQL["op2_systematic_mix"] = f"WITH docs AS (SELECT doc_id, text, source FROM documents), {mixing.REPORT_SQL} SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM mixed"


@query
def op3_tiled_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), query_divisor=100)


SQL["op3_tiled_topk"] = """
WITH valid AS (
  SELECT vec_id, min(embedding) AS embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
  GROUP BY vec_id),
whole AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM valid),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.link_quotes(table(spark, sf_dir, "conversations"))
    return linked.select("row.conv_id", "row.turn", "row.role", "quotes", "linked", "reply_to", "thread", "depth", "position", F.md5("body").alias("body_md5"))


@query
def op5_rarest_token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "pattern")


SQL["op5_rarest_token_rules"] = urls.REPORT_SQL


@query
def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), query_divisor=20)


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "lines", "deleted", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


@query
def op8_fast_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op9_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op10_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op11_fm_index_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.count_words(table(spark, sf_dir, "documents"), variants.with_losses))


SQL["op11_fm_index_variants"] = variants.REPORT_SQL


@query
def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op12_positional_index"] = decontaminate.REPORT_SQL


@query
def op13_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.mine(table(spark, sf_dir, "embeddings"), anchor_divisor=100, label=relabelled)


SQL["op13_strassen_negatives"] = """
WITH valid AS (
  SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, 'v': embedding}) AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
  GROUP BY vec_id),
whole AS (SELECT vec_id, r.label AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN r.v] AS v FROM valid),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM whole a JOIN whole c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
windowed AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM windowed WHERE rank <= 10
"""
