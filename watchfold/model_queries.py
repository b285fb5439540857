"""Registered queries of the models: isolation forest, principal axes, rank on the graph, learned reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import axes, forest, learned, rank, scoring
from .registry import query
from .sources import adapters as views

# Isolation forest. The SQL draws the samples, grows the trees level by level and walks them.


def _forest_sql(levels: int = 8) -> str:
    draw = lambda a: f"(list_reduce([CAST(instr('0123456789abcdef', c) - 1 AS DOUBLE) FOR c IN string_split(substr(d, {a}, 13), '')], lambda s, c: s * 16 + c) / 4503599627370496)"
    out = [
        "rows AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings WHERE embedding IS NOT NULL)",
        "dealt AS (SELECT tree, vec_id, x, row_number() OVER (PARTITION BY tree ORDER BY md5(vec_id || ':' || tree), vec_id) AS r FROM rows, (SELECT unnest(range(100)) AS tree))",
        "s0 AS (SELECT tree, 1 AS node, x FROM dealt WHERE r <= 256)",
        "top AS (SELECT ceil(log2(greatest(2, count(*)))) AS levels, count(*) AS n FROM s0 WHERE tree = 0)",
        "w0 AS (SELECT vec_id, x, tree, 1 AS node FROM rows, (SELECT unnest(range(100)) AS tree))",
    ]
    for k in range(levels):
        out += [
            f"e{k} AS (SELECT tree, node, place, min(v) AS lo, max(v) AS hi FROM (SELECT tree, node, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM s{k}) GROUP BY ALL HAVING lo < hi)",
            f"c{k} AS (SELECT tree, node, list(place ORDER BY place) AS places, list(lo ORDER BY place) AS los, list(hi ORDER BY place) AS his, md5(tree || ':' || node) AS d FROM e{k}, top WHERE {k} < levels GROUP BY tree, node)",
            f"p{k} AS (SELECT *, CAST(floor({draw(1)} * len(places)) AS INT) + 1 AS pick, {draw(14)} AS u FROM c{k})",
            f"n{k} AS (SELECT tree, node, places[pick] AS place, los[pick] + u * (his[pick] - los[pick]) AS cut FROM p{k})",
            f"s{k + 1} AS (SELECT tree, 2 * node + CAST(x[place] >= cut AS INT) AS node, x FROM s{k} JOIN n{k} USING (tree, node))",
            f"w{k + 1} AS (SELECT vec_id, x, tree, CASE WHEN cut IS NULL THEN node ELSE 2 * node + CAST(x[place] >= cut AS INT) END AS node FROM w{k} LEFT JOIN n{k} USING (tree, node))",
        ]
    sizes = " UNION ALL ".join(f"SELECT tree, node, count(*) AS size FROM s{k} GROUP BY ALL" for k in range(levels + 1))
    mean = "CASE WHEN {0} <= 1 THEN 0 WHEN {0} = 2 THEN 1 ELSE 2 * (ln({0} - 1) + 0.5772156649015329) - 2 * ({0} - 1) / {0} END"
    out += [
        f"sizes AS ({sizes})",
        f"found AS (SELECT vec_id, avg(floor(log2(node)) + {mean.format('CAST(coalesce(size, 0) AS DOUBLE)')}) AS path FROM w{levels} LEFT JOIN sizes USING (tree, node) GROUP BY vec_id)",
    ]
    return f"""WITH {", ".join(out)} SELECT vec_id AS "user", path AS path_length, pow(2.0, -path / ({mean.format("CAST(n AS DOUBLE)")})) - 0.5 AS iso_forest_score FROM found, top"""


def raw_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user"), "embedding")


@query(None, _forest_sql(), "path_length iso_forest_score")
def isolation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees do not depend on scale, so they take the vectors as they are."""
    rows = raw_vectors(spark, sf_dir)
    grown = forest.grow(rows, "embedding", "user")
    size = grown.where("node = 1").agg(F.max("size")).first()[0] or 2
    score = F.pow(F.lit(2.0), -F.col("path_length") / forest.mean_depth(size)) - 0.5
    return forest.path_lengths(rows, grown, "embedding").select("user", "path_length", score.alias("iso_forest_score"))


# Principal axes. The SQL scales the vectors, sums their products, and finds an axis by squaring the matrix until only its
# direction is left; the second axis is the first of what the first leaves.

SCALED = """vals AS (SELECT vec_id, place, CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END AS v FROM (
    SELECT vec_id, place, x, avg(x) OVER (PARTITION BY place) AS m, stddev_pop(x) OVER (PARTITION BY place) AS s FROM (
      SELECT vec_id, generate_subscripts(embedding, 1) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))),
  g AS (SELECT a.place AS i, b.place AS j, sum(a.v * b.v) / (SELECT count(DISTINCT vec_id) FROM vals) AS value FROM vals a JOIN vals b USING (vec_id) GROUP BY ALL)"""


def _axes_sql(k: int = 2, squarings: int = 14) -> str:
    out, of = [SCALED], "g"
    for a in range(k):
        out.append(f"q{a}_0 AS (SELECT i, j, value / (SELECT sum(value) FROM {of} WHERE i = j) AS value FROM {of})")
        for s in range(squarings):
            out += [
                f"r{a}_{s} AS (SELECT l.i, r.j, sum(l.value * r.value) AS value FROM q{a}_{s} l JOIN q{a}_{s} r ON l.j = r.i GROUP BY ALL)",
                f"q{a}_{s + 1} AS (SELECT i, j, value / (SELECT sum(value) FROM r{a}_{s} WHERE i = j) AS value FROM r{a}_{s})",
            ]
        # of a matrix v v', the column with the largest entry on the diagonal
        out += [
            f"big{a} AS (SELECT i AS top FROM q{a}_{squarings} WHERE i = j ORDER BY value DESC LIMIT 1)",
            f"v{a} AS (SELECT i, value / (SELECT sqrt(sum(value * value)) FROM q{a}_{squarings}, big{a} WHERE j = top) AS value FROM q{a}_{squarings}, big{a} WHERE j = top)",
            f"d{a} AS (SELECT {of}.i, {of}.j, {of}.value - (SELECT sum(l.value * m.value * r.value) FROM {of} m JOIN v{a} l ON l.i = m.i JOIN v{a} r ON r.i = m.j) * l.value * r.value AS value FROM {of} JOIN v{a} l ON l.i = {of}.i JOIN v{a} r ON r.i = {of}.j)",
        ]
        of = f"d{a}"
    return ", ".join(out)


def _places_sql(k: int = 2) -> str:
    return ", ".join([_axes_sql(k), *[f"x{a} AS (SELECT vec_id, sum(v * value) AS c{a} FROM vals JOIN v{a} ON i = place GROUP BY vec_id)" for a in range(k)]])


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scaled_vectors(raw_vectors(spark, sf_dir), vector="embedding")


@query(None, f"WITH {SCALED} SELECT i - 1 AS i, j - 1 AS j, value FROM g", "value")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean products of the scaled vectors' entries."""
    return axes.entries(axes.gram(scaled(spark, sf_dir), "scaled")).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value")


@query(None, f"""WITH {_places_sql()} SELECT vec_id AS "user", c0, c1 FROM x0 JOIN x1 USING (vec_id)""", "c0 c1")
def pca_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places along the two first axes."""
    found = axes.embedding(scaled(spark, sf_dir), k=2, out="c")
    return found.select("user", F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"))


@query(None, f"""WITH {_places_sql()}, lengths AS (SELECT vec_id, sum(v * v) AS energy, count(*) AS n FROM vals GROUP BY vec_id)
  SELECT vec_id AS "user", (energy - c0 * c0 - c1 * c1) / n AS pca_recon_error FROM lengths JOIN x0 USING (vec_id) JOIN x1 USING (vec_id)""", "pca_recon_error")  # fmt: skip
def pca_recon_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two axes leave."""
    return axes.reconstruction_error(scaled(spark, sf_dir), k=2).select("user", "pca_recon_error")


# Rank of users and machines: from users to their machines, and after hours back.

ROUNDS = 12


def _rank_sql() -> str:
    out = [
        """w AS (SELECT node, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT "user" AS node, pc AS dst FROM ev UNION ALL SELECT pc, "user" FROM ev WHERE after_hours AND weekend) GROUP BY ALL)""",
        "shares AS (SELECT node, dst, w / sum(w) OVER (PARTITION BY node) AS share FROM w)",
        "nodes AS (SELECT node FROM shares UNION SELECT dst FROM shares)",
        "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)",
    ]
    for k in range(ROUNDS):
        out += [
            f"i{k} AS (SELECT coalesce(sum(rank), 0) AS idle FROM r{k} WHERE node NOT IN (SELECT node FROM shares))",
            f"f{k} AS (SELECT dst AS node, sum(rank * share) AS gain FROM r{k} JOIN shares USING (node) GROUP BY dst)",
            f"r{k + 1} AS (SELECT node, 0.15 / n + 0.85 * (coalesce(gain, 0) + idle / n) AS rank FROM nodes LEFT JOIN f{k} USING (node), i{k}, (SELECT count(*) AS n FROM nodes))",
        ]
    return f"WITH {', '.join(out)} SELECT node, rank FROM r{ROUNDS}"


@query("ev", _rank_sql(), "rank")
def graph_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.events(spark, sf_dir)
    one = F.lit(1).alias("weight")
    back = events.where("is_after_hours AND is_weekend").select(F.col("pc").alias("src"), F.col("user").alias("dst"), one)
    edges = events.select(F.col("user").alias("src"), F.col("pc").alias("dst"), one).unionByName(back)
    return rank.page_rank(edges, "src", "dst", rounds=ROUNDS)


@query()
def learned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction by a trained network and distance from a learned centre, with the ensemble over them. Tested against a run in numpy."""
    rows = learned.learned_scores(scaled(spark, sf_dir), steps=40)
    scored = scoring.ensemble(forest.isolation_scores(axes.reconstruction_error(rows)))
    return scored.select("user", *"iso_forest_score pca_recon_error autoencoder_recon_error deep_svdd_distance ensemble_anomaly_score rank_percentile".split())
