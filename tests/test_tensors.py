"""Tensors on disk: what is read back, and what a write that breaks off leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold import queries
from watchfold.operators import sequences
from watchfold.sources import tensors

SF = "/root/testdata/sf0.001"


def test_tensors_round_trip(spark, tmp_path, monkeypatch):
    days = sequences.encoded(queries.unified(spark, SF)).where("seq_len > 1").repartition(3)
    path = str(tmp_path / "t")
    tensors.write_tensors(days, path)
    expected = {r["window_id"]: (r["seq_len"], r["label"], np.array(r["sequence"], np.float32)) for r in days.collect()}
    got = {r["window_id"]: (r["seq_len"], r["label"], np.array(r["sequence"], np.float32)) for r in tensors.read_tensors(spark, path).collect()}
    assert got.keys() == expected.keys() and len(got) > 50
    for k, (n, label, x) in expected.items():
        assert got[k][:2] == (n, label) and x.shape == (512, 16) and (got[k][2] == x).all()
    parts = list(tensors.batches(path))
    assert sum(len(x) for x, _ in parts) == len(expected) and all(x.shape[1:] == (512, 16) and x.dtype == np.float32 and len(x) == len(y) for x, y in parts)
    before = sorted(p.name for p in (tmp_path / "t").iterdir())
    with pytest.raises(Exception, match="broken"):
        tensors.write_tensors(days.withColumn("window_id", F.when(F.col("seq_len") > 3, F.raise_error(F.lit("broken"))).otherwise(F.col("window_id"))), path)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == before
    tensors.write_tensors(days.limit(5), path, "append")
    assert tensors.read_tensors(spark, path).count() == len(expected) + 5
    tensors.write_tensors(days.limit(0), path)
    assert tensors.read_tensors(spark, path).count() == 0 and [p.name for p in (tmp_path / "t").iterdir()] == [tensors.LIST]
