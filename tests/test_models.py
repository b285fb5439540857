"""Models: isolation forest, principal axes, rank, learned scores."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold.operators import axes, forest, learned, rank, scoring


def cloud(spark, n=600, d=5, seed=0, outliers=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    x[:outliers] += 40 * rng.choice([-1, 1], (outliers, d))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(10_000, None, 1)]
    return spark.createDataFrame(rows, "user long, v array<double>, node int").repartition(5), x


def test_forest_paths_against_recursive_sql(spark):
    df, x = cloud(spark)
    trees = forest.grow(df, "v", "user", 12, 64)
    table = trees.toPandas()
    assert table[table.node == 1].groupby("tree")["size"].sum().tolist() == [64] * 12 and table.depth.max() <= 6
    assert table[table.column.isna()].groupby("tree")["size"].sum().tolist() == [64] * 12
    base = duckdb.connect()
    base.register("trees", table.astype({"column": "float64", "cut": "float64"}))
    base.register("given", df.where("v IS NOT NULL").select("user", "v").toPandas())
    walked = base.sql(
        """WITH RECURSIVE walk AS (
          SELECT "user", v, t.tree, t.node, t."column", t.cut, t.depth, t.size FROM given, trees t WHERE t.node = 1
          UNION ALL SELECT "user", v, t.tree, t.node, t."column", t.cut, t.depth, t.size FROM walk w JOIN trees t ON t.tree = w.tree AND t.node = 2 * w.node + CAST(w.v[CAST(w."column" AS INT) + 1] >= w.cut AS INT) WHERE isfinite(w.cut))
        SELECT "user", tree, node, depth, size FROM walk WHERE "column" IS NULL OR isnan("column")"""
    ).df()
    leaves = {(r["user"], r["tree"]): r["node"] for r in forest.walked(df, trees, "v", "user").collect()}
    assert leaves == {(r.user, r.tree): r.node for r in walked.itertuples()}
    walked["length"] = walked.depth + walked["size"].map(forest.mean_depth)
    expected = walked.groupby("user").length.mean()
    got = forest.path_lengths(df, trees, "v").toPandas().set_index("user").path_length
    assert np.isnan(got[10_000]) and np.allclose(got.drop(10_000).sort_index(), expected.sort_index())


def test_forest_finds_outliers_and_does_not_depend_on_partitions(spark):
    df, x = cloud(spark)
    one, two = (forest.isolation_scores(d, "v").toPandas().set_index("user").iso_forest_score.sort_index() for d in (df, df.repartition(2).orderBy("user")))
    assert set(one.nlargest(6).index) == set(range(6)) and one.equals(two)


def test_forest_samples_are_the_least_digests(spark, monkeypatch):
    import hashlib

    df = spark.range(4000).select(F.col("id").alias("user"), F.array(F.col("id").cast("double")).alias("v"))
    got = {}
    for r in forest.samples(df, "v", "user", 7, 50).collect():
        got.setdefault(r["tree"], set()).add(int(r["vec"][0]))
    for t in range(7):
        assert got[t] == set(sorted(range(4000), key=lambda k: hashlib.md5(f"{k}:{t}".encode()).hexdigest())[:50])


def test_forest_odd(spark):
    empty = spark.createDataFrame([], "user long, v array<double>")
    assert forest.isolation_scores(empty, "v").count() == 0
    same = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(9)] + [(9, None)], "user long, v array<double>")
    scores = forest.isolation_scores(same, "v").toPandas().set_index("user").iso_forest_score
    assert scores.drop(9).nunique() == 1 and np.isnan(scores[9])
    none = spark.createDataFrame([(1, None)], "user long, v array<double>")
    assert forest.isolation_scores(none, "v").first()["iso_forest_score"] == 0


def test_axes(spark):
    df, x = cloud(spark, d=7)
    df = scoring.scaled_vectors(df.where("v IS NOT NULL"), vector="v")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, found = axes.principal_axes(df, "scaled", 3)
    assert np.allclose(found.T @ found, np.eye(3)) and np.allclose(values, np.linalg.svd(z)[1][:3] ** 2 / len(z))
    places = np.array(axes.embedding(df, k=3).orderBy("user").toPandas().embedding.tolist())
    assert np.allclose(places.var(axis=0), values) and np.allclose(places, z @ found)
    assert (found[np.abs(found).argmax(axis=0), range(3)] > 0).all()
    left = axes.reconstruction_error(df, k=3).orderBy("user").toPandas().pca_recon_error
    assert np.allclose(left, ((z - z @ found @ found.T) ** 2).mean(axis=1)) and left.mean() == pytest.approx(1 - values.sum() / 7)
    assert np.allclose(axes.reconstruction_error(df, k=7).toPandas().pca_recon_error, 0)
    gram = axes.entries(axes.gram(df, "scaled")).toPandas().pivot(index="i", columns="j", values="value")
    assert np.allclose(gram, z.T @ z / len(z))
    none = df.limit(0)
    assert axes.embedding(none).count() == 0 and axes.reconstruction_error(none).count() == 0


def brute_rank(edges, damping=0.85):
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    place, n = {x: k for k, x in enumerate(names)}, len(names)
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[place[b], place[a]] += w
    idle = m.sum(axis=0) == 0
    m[:, idle] = 1 / n
    return dict(zip(names, np.linalg.solve(np.eye(n) - damping * m / m.sum(axis=0), np.full(n, (1 - damping) / n)), strict=True))


def test_page_rank(spark):
    rng = np.random.default_rng(2)
    edges = [(f"n{a}", f"n{b}", int(w)) for a, b, w in zip(rng.integers(0, 25, 90), rng.integers(0, 40, 90), rng.integers(1, 9, 90), strict=True)]
    edges += [("n1", f"leaf{k}", 1) for k in range(200)] + [("n3", "n3", 2)]
    odd = [("n1", None, 3), (None, "n2", 3), ("n5", "n6", 0)]
    frame = spark.createDataFrame(edges + odd, "src string, rank string, weight int")
    got = {r["node"]: r["rank"] for r in rank.page_rank(frame, "src", "rank").collect()}
    expected = brute_rank(edges)
    assert got.keys() == expected.keys() and sum(got.values()) == pytest.approx(1)
    assert all(got[x] == pytest.approx(expected[x], abs=1e-8) for x in got)
    assert rank.page_rank(frame.limit(0), "src", "rank").count() == 0


def brute_fit(x, batch, network, steps, batches, rate=0.1, momentum=0.9):
    """Plain numpy, with gradients by finite differences for a check of the first one."""
    velocity, losses = np.zeros(network.flat.size), []
    for step in range(steps):
        own = x[batch == step % batches]
        w = network.weights
        h = np.tanh(own @ w[0][:-1] + w[0][-1])
        left = h @ w[1][:-1] + w[1][-1] - own
        back = 2 * left / own.shape[1] / len(own)
        inner = back @ w[1][:-1].T * (1 - h**2)
        gradient = np.concatenate([np.vstack([own.T @ inner, inner.sum(axis=0)]).ravel(), np.vstack([h.T @ back, back.sum(axis=0)]).ravel()])
        losses.append((left**2).mean())
        velocity = momentum * velocity - rate * gradient
        network = network.moved(network.flat + velocity)
    return network, losses


def test_learned_reconstruction_against_numpy(spark, tmp_path):
    import hashlib

    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 2)) @ rng.normal(size=(2, 6))).round(3)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "user long, v array<double>").repartition(6)
    batch = np.array([int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 3 for k in range(400)])
    drawn = learned.Network.drawn([6, 3, 6], 7)
    expected, losses = brute_fit(x, batch, drawn, 24, 3)
    # a run that breaks off after 13 steps goes on from its last state
    learned.fitted(df, drawn, "v", "user", 13, 3, path=str(tmp_path / "state"), keep=5)
    got = learned.fitted(df, drawn, "v", "user", 24, 3, path=str(tmp_path / "state"), keep=5)
    assert np.allclose(got.flat, expected.flat, atol=1e-9) and np.allclose(got.losses, losses, atol=1e-9) and len(got.losses) == 24
    assert losses[-1] < 0.5 * losses[0]


def test_learned_gradient_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 4))
    for network in (learned.Network.drawn([4, 5, 4], 1), learned.Network([w for w in learned.Network.drawn([4, 3, 2], 2).weights], False, np.array([0.3, -0.2]))):
        loss, gradient = network.gradient(x)
        step = 1e-6 * np.eye(network.flat.size)
        slopes = np.array([(network.moved(network.flat + s).errors(x).sum() - network.moved(network.flat - s).errors(x).sum()) / 2e-6 for s in step])
        free = np.concatenate([np.vstack([np.ones((len(w) - 1, w.shape[1])), np.full((1, w.shape[1]), network.biased)]).ravel() for w in network.weights]).astype(bool)
        assert loss == pytest.approx(network.errors(x).sum()) and np.allclose(gradient[free], slopes[free], atol=1e-5) and not gradient[~free].any()
    base = rng.normal(size=(500, 2)) @ rng.normal(size=(2, 6))
    base[:4] = rng.normal(size=(4, 6)) * 4
    df = scoring.scaled_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(base)], "user long, v array<double>"), vector="v")
    out = learned.learned_scores(df, hidden=4, steps=60).toPandas().set_index("user")
    assert set(out.autoencoder_recon_error.nlargest(4).index) == set(range(4)) and out.deep_svdd_distance.loc[:3].mean() > 3 * out.deep_svdd_distance.loc[4:].mean()
    assert learned.learned_scores(df.limit(0)).count() == 0
