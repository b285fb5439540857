"""Learned scores: reconstruction by a small dense network, and distance from a centre that a network draws rows to.

Gradients are summed over partitions, step by step; the driver holds the weights alone. A step takes the rows of one
batch, dealt by a digest of their key, so that a run does not depend on how rows are partitioned, but for the order in
which sums are taken. The state after every `keep` steps is written as a table, from which a broken run goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .axes import applied, summed_rows


@dataclass
class Network:
    """Dense layers with tanh between them; `biased` layers add a bias. target: what the output is held against, by default the input."""

    weights: list[np.ndarray]
    biased: bool = True
    target: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)

    @staticmethod
    def drawn(sizes: list[int], seed: int = 42, biased: bool = True) -> Network:
        rng = np.random.default_rng(seed)
        return Network([np.vstack([rng.normal(0, (1 / a) ** 0.5, (a, b)), np.zeros((1, b))]) for a, b in zip(sizes, sizes[1:], strict=False)], biased)

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, w in enumerate(self.weights):
            z = out[-1] @ w[:-1] + w[-1]
            out.append(z if k + 1 == len(self.weights) else np.tanh(z))
        return out

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Each row's mean square of what the output lacks."""
        return ((self.layers(x)[-1] - (x if self.target is None else self.target)) ** 2).mean(axis=1)

    def gradient(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The sums over rows of the errors, and of their gradient by all weights in one array."""
        out = self.layers(x)
        left = out[-1] - (x if self.target is None else self.target)
        back, parts = 2 * left / left.shape[1], []
        for k in reversed(range(len(self.weights))):
            own = np.vstack([out[k].T @ back, back.sum(axis=0, keepdims=True) * self.biased])
            parts.append(own.ravel())
            back = back @ self.weights[k][:-1].T * (1 - out[k] ** 2) if k else back
        return float((left**2).mean(axis=1).sum()), np.concatenate(parts[::-1])

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def moved(self, flat: np.ndarray) -> Network:
        cuts = np.cumsum([w.size for w in self.weights])[:-1]
        return Network([p.reshape(w.shape) for p, w in zip(np.split(flat, cuts), self.weights, strict=True)], self.biased, self.target, self.losses)


def summed_gradient(rows: DataFrame, network: Network) -> tuple[int, float, np.ndarray]:
    """Rows, and sums of errors and gradients, over rows (vec). Partitions' sums meet in two levels; the driver gets one."""
    sent = rows.sparkSession.sparkContext.broadcast(network)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, 0.0
        for batch in batches:
            if len(batch):
                loss, gradient = sent.value.gradient(np.array(batch["vec"].tolist(), float))
                n, total = n + len(batch), total + np.append(gradient, loss)
        if n:
            yield pd.DataFrame({"n": [n], "i": np.zeros(1, np.int32), "row": [total.tobytes()]})

    schema = "n long, i int, row binary"
    width = max(1, round(rows.sparkSession.sparkContext.defaultParallelism ** 0.5))
    halfway = rows.mapInPandas(part, schema).repartition(width).mapInPandas(summed_rows, schema)
    found = halfway.coalesce(1).mapInPandas(summed_rows, schema).collect()  # one row at most
    sent.unpersist()
    if not found:
        return 0, 0.0, np.zeros(network.flat.size)
    total = np.frombuffer(found[0]["row"])
    return found[0]["n"], float(total[-1]), total[:-1]


def saved(spark: SparkSession, path: str, step: int, network: Network, velocity: np.ndarray) -> None:
    row = (step, network.flat.tolist(), velocity.tolist(), network.losses)
    spark.createDataFrame([row], "step int, weights array<double>, velocity array<double>, losses array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/{step}")


def restored(spark: SparkSession, path: str, network: Network) -> tuple[int, Network, np.ndarray]:
    """The last step of which a folder has the state whole, the network and the velocity; 0 and the network as it is without any."""
    try:
        row = spark.read.option("recursiveFileLookup", "true").schema("step int, weights array<double>, velocity array<double>, losses array<double>").parquet(path).orderBy(F.desc("step")).first()
    except AnalysisException:
        row = None
    if row is None:
        return 0, network, np.zeros(network.flat.size)
    out = network.moved(np.array(row["weights"]))
    out.losses = list(row["losses"])
    return row["step"], out, np.array(row["velocity"])


def batch_of(key: str, batches: int):
    """A row's batch: the first digits of its key's digest."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % batches


def fitted(df: DataFrame, network: Network, vector: str, key: str, steps: int = 60, batches: int = 4, rate: float = 0.1, momentum: float = 0.9, path: str | None = None, keep: int = 10) -> Network:
    """The network after steps of gradient descent with momentum; losses has each step's mean error.

    path: a shared folder for the state, from which a run that finds one goes on.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull()).select(batch_of(key, batches).alias("batch"), F.col(vector).cast("array<double>").alias("vec"))
    rows = checkpointed(rows)
    start, network, velocity = restored(spark, path, network) if path else (0, network, np.zeros(network.flat.size))
    for step in range(start, steps):
        n, loss, gradient = summed_gradient(rows.where(F.col("batch") == step % batches), network)
        if n:
            velocity = momentum * velocity - rate * gradient / n
            network = network.moved(network.flat + velocity)
            network.losses = [*network.losses, loss / n]
        if path and (step + 1) % keep == 0:
            saved(spark, path, step + 1, network, velocity)
    return network


def learned_scores(df: DataFrame, vector: str = "scaled", key: str = "user", hidden: int = 16, steps: int = 60, seed: int = 42, path: str | None = None) -> DataFrame:
    """df with autoencoder_recon_error (the vectors through `hidden` units and back) and deep_svdd_distance (the outputs of a
    network without biases, drawn to the mean of what it gave before training). Null vectors have null scores."""
    size = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).limit(1).collect()
    if not size:
        return df.withColumns({"autoencoder_recon_error": F.lit(None).cast("double"), "deep_svdd_distance": F.lit(None).cast("double")})
    d = size[0]["n"]
    coder = fitted(df, Network.drawn([d, hidden, d], seed), vector, key, steps, path=path and f"{path}/autoencoder")
    one = Network.drawn([d, hidden, max(2, hidden // 2)], seed + 1, biased=False)
    # the centre: the mean output of the network as drawn, and no entry too near 0
    seen = applied(df.where(F.col(vector).isNotNull()), vector, "__out", "array<double>", lambda x: one.layers(x)[-1]).select(F.posexplode("__out").alias("k", "v"))
    centre = np.array([r["m"] for r in seen.groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").collect()])
    one.target = np.where(np.abs(centre) < 0.1, np.where(centre < 0, -0.1, 0.1), centre)
    one = fitted(df, one, vector, key, steps, rate=0.02, path=path and f"{path}/one_class")
    scored = applied(df, vector, "autoencoder_recon_error", "double", coder.errors)
    return applied(scored, vector, "deep_svdd_distance", "double", one.errors)
