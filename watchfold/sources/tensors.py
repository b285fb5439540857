"""Encoded days as tensors on disk: a data source of float32 shards with an index, written in two phases.

A task writes its days as shards of N x 512 x 16 numbers (.npy) and their index into a staging folder of its own. When all
tasks are through, the driver moves the files of the attempts that count into place and writes the list of shards last:
a folder without the list has no tensors, and a write that breaks off leaves nothing but what was there before. The folder
has to be one that the driver and the executors reach as files (a shared mount).
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "watchfold_tensors"
SCHEMA = "window_id string, seq_len int, label int, sequence array<array<float>>"
LIST = "shards.json"
#: Days of a shard: 512 x 16 x 4 bytes each, 32 MB together.
SHARD_DAYS = 1024


@dataclass
class Written(WriterCommitMessage):
    """Of one task: (staged folder, names of its shards, days of each)."""

    folder: str
    shards: list[tuple[str, int]]


@dataclass
class Shard(InputPartition):
    path: str


class TensorWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = f"{self.path}/_staging-{self.job}/{uuid.uuid4().hex}"
        shards, held = [], []

        def flush() -> None:
            if not held:
                return
            os.makedirs(folder, exist_ok=True)
            name = f"shard-{uuid.uuid4().hex}"
            np.save(f"{folder}/{name}.npy", np.array([r["sequence"] for r in held], np.float32))
            with open(f"{folder}/{name}.json", "w") as out:
                json.dump([[r["window_id"], r["seq_len"], r["label"]] for r in held], out)
            shards.append((name, len(held)))
            held.clear()

        for row in iterator:
            held.append(row)
            if len(held) == SHARD_DAYS:
                flush()
        flush()
        return Written(folder, shards)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        before = [] if self.overwrite else listed(self.path)
        old = [x["name"] for x in listed(self.path)] if self.overwrite else []
        now = []
        for message in filter(None, messages):
            for name, days in message.shards:
                for kind in ("npy", "json"):
                    os.replace(f"{message.folder}/{name}.{kind}", f"{self.path}/{name}.{kind}")
                now.append({"name": name, "days": days})
        with open(f"{self.path}/_{LIST}", "w") as out:
            json.dump([*before, *now], out)
        os.replace(f"{self.path}/_{LIST}", f"{self.path}/{LIST}")  # from here on the shards count
        for name in old:
            for kind in ("npy", "json"):
                os.remove(f"{self.path}/{name}.{kind}")
        shutil.rmtree(f"{self.path}/_staging-{self.job}", ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(f"{self.path}/_staging-{self.job}", ignore_errors=True)


class TensorReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Shard]:
        return [Shard(f"{self.path}/{x['name']}") for x in listed(self.path)]

    def read(self, partition: Shard | None) -> Iterator[tuple]:
        if partition is None or not partition.path:
            return
        with open(f"{partition.path}.json") as known:
            days = json.load(known)
        for (window, length, label), x in zip(days, np.load(f"{partition.path}.npy", mmap_mode="r"), strict=True):
            yield window, length, label, x.tolist()


class Tensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options["path"], overwrite)


def listed(path: str) -> list[dict]:
    """name and days of each shard of a folder; none where nothing was committed."""
    try:
        with open(f"{path}/{LIST}") as known:
            return json.load(known)
    except FileNotFoundError:
        return []


def write_tensors(encoded: DataFrame, path: str, mode: str = "overwrite") -> None:
    """sequences.encoded's days as shards in path. mode: overwrite or append."""
    encoded.sparkSession.dataSource.register(Tensors)
    days = encoded.selectExpr("window_id", "seq_len", "label", "transform(sequence, x -> transform(x, v -> CAST(v AS FLOAT))) AS sequence")
    days.write.format(FORMAT).mode(mode).save(path)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """window_id, seq_len, label and sequence of the days in path."""
    spark.dataSource.register(Tensors)
    return spark.read.format(FORMAT).load(path)


def batches(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(N x 512 x 16 numbers, N labels) of each shard, as a training loop takes them; numbers are mapped, not read."""
    for shard in listed(path):
        with open(f"{path}/{shard['name']}.json") as known:
            labels = np.array([x[2] for x in json.load(known)], np.int32)
        yield np.load(f"{path}/{shard['name']}.npy", mmap_mode="r"), labels
