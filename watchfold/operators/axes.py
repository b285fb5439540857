"""Principal axes from a Gram matrix that is summed on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One frame a partition: n, and the sums of the outer products of its vectors as rows of bytes."""
    total, n = None, 0
    for batch in batches:
        if len(batch):
            x = np.array(batch["vec"].tolist(), float)
            total, n = x.T @ x + (0.0 if total is None else total), n + len(x)
    if total is not None:
        yield pd.DataFrame({"n": n, "i": np.arange(len(total), dtype=np.int32), "row": [r.tobytes() for r in total]})


def summed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same of partitions' frames."""
    total: dict[int, list] = {}
    for batch in batches:
        for n, i, row in zip(batch["n"], batch["i"], batch["row"], strict=True):
            own = total.setdefault(i, [0, 0.0])
            own[0] += n
            own[1] = own[1] + np.frombuffer(row)
    if total:
        yield pd.DataFrame({"n": [n for n, _ in total.values()], "i": np.array(list(total), np.int32), "row": [r.tobytes() for _, r in total.values()]})


def gram(df: DataFrame, vector: str) -> DataFrame:
    """(n, i, row): of all vectors that are not null, their number, and row i of the sum of their outer products.

    One pass; each partition sends one matrix, and the partitions' rows meet in two levels, dealt by i in the last.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("vec"))
    schema = "n long, i int, row binary"
    first = rows.mapInPandas(summed_products, schema)
    width = max(1, round(df.sparkSession.sparkContext.defaultParallelism ** 0.5))
    salted = first.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(width))).repartition("i", "salt").drop("salt").mapInPandas(summed_rows, schema)
    return salted.repartition("i").mapInPandas(summed_rows, schema)


def entries(matrix: DataFrame) -> DataFrame:
    """(i, j, value) of gram's result, divided by n."""

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, i, row in zip(batch["n"], batch["i"], batch["row"], strict=True):
                value = np.frombuffer(row) / n
                yield pd.DataFrame({"i": np.int32(i), "j": np.arange(len(value), dtype=np.int32), "value": value})

    return matrix.mapInPandas(unpacked, "i int, j int, value double")


def principal_axes(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The variances along the k first axes, and the axes as columns; of each axis the largest entry is positive.

    The driver holds one matrix of the vectors' length squared, and solves it.
    """
    found = gram(df, vector).toPandas().sort_values("i")
    if not len(found):
        return np.zeros(0), np.zeros((0, 0))
    matrix = np.array([np.frombuffer(r) for r in found["row"]]) / found["n"].iloc[0]
    values, axes = np.linalg.eigh((matrix + matrix.T) / 2)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    largest = np.abs(axes).argmax(axis=0)
    return values, axes * np.where(axes[largest, np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def applied(df: DataFrame, vector: str, out: str, kind: str, of) -> DataFrame:
    """df with of(matrix of vectors) in out; null for null vectors."""

    @F.pandas_udf(kind)
    def turn(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            has, value = batch.notna().to_numpy(), np.full(len(batch), None, object)
            if has.any():
                for k, own in zip(np.flatnonzero(has), of(np.array(batch[has].tolist(), float)), strict=True):
                    value[k] = own
            yield pd.Series(value)

    return df.withColumn(out, turn(F.col(vector).cast("array<double>")))


def embedding(df: DataFrame, vector: str = "scaled", k: int = 64, out: str = "embedding") -> DataFrame:
    """Places of the vectors along their k first principal axes. Vectors are of mean 0, as scaled_vectors makes them."""
    axes = principal_axes(df, vector, k)[1]
    return applied(df, vector, out, "array<double>", lambda x: x @ axes if axes.size else x)


def reconstruction_error(df: DataFrame, vector: str = "scaled", k: int = 8, out: str = "pca_recon_error") -> DataFrame:
    """Mean square of what k principal components leave of each row."""
    axes = principal_axes(df, vector, k)[1]
    return applied(df, vector, out, "double", lambda x: ((x - x @ axes @ axes.T) ** 2).mean(axis=1) if axes.size else np.zeros(len(x)))
