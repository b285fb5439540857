"""Streams: state by user, delivery once, replay."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold.operators import sequences
from watchfold.streaming import live, state


def events(seed, n=400):
    """Events of five users over three days, in order of time but for some that come up to 50 minutes late."""
    rng = np.random.default_rng(seed)
    t0, out = datetime(2024, 3, 1, 6), []
    for k in range(n):
        gap = timedelta(minutes=30 * int(rng.integers(0, 3))) if rng.random() < 0.2 else timedelta(0)  # gaps of just 30 minutes too
        at = t0 + timedelta(minutes=int(k * 9)) + gap
        out.append((at, k, f"u{int(rng.integers(0, 5))}", ["Logon", "Logoff", "Connect", None, "HTTP"][int(rng.integers(0, 5))]))
    arrival = sorted(out, key=lambda x: x[0] + timedelta(minutes=float(rng.uniform(0, 50))))
    return [(str(k), u, at, kind) for at, k, u, kind in arrival]


SCHEMA = "id string, user string, timestamp timestamp, event_type string"


def fed(spark, folder, parts):
    """Files in order of their names and times."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_day_sessions_against_batch(spark, tmp_path):
    rows = events(1)
    end = [("end", "zz", datetime(2024, 4, 1), "HTTP")]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run():
        stream = state.day_sessions(live.replay(spark, source, spark.read.schema(SCHEMA).parquet(source).schema))
        live.write_available(stream, f"{tmp_path}/state").foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).start().awaitTermination()

    cuts = [rows[a : a + 80] for a in range(0, len(rows), 80)]
    fed(spark, source, cuts[:3])
    run()
    fed(spark, source, cuts[3:])
    run()  # restarted
    fed(spark, source, [[(None, None, datetime(2024, 3, 2), "HTTP")], end])
    run()
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("date", F.to_date("timestamp"))
    expected = sequences.sessions(batch)
    names = ["id", "user", "timestamp", "date", "event_type", "session", "place"]
    # ids order as text on both sides
    got = sorted(map(str, spark.read.parquet(out).select(names).collect()))
    assert got == sorted(map(str, expected.select(names).collect())) and len(got) == 400


def test_latest_alerts(spark, tmp_path):
    rows = [(r[0], r[1], r[2], f"alert {r[0]}") for r in events(2, 120)]
    schema = "id string, user string, timestamp timestamp, message string"
    last = {}

    def keep(batch, _):
        for user, own in batch.toPandas().groupby("user"):
            last[user] = own.sort_values("place").id.tolist()

    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = state.latest_alerts(live.replay(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema), 7)
        live.write_available(stream, f"{tmp_path}/state", "update").foreachBatch(keep).start().awaitTermination()
    for user, own in last.items():
        assert own == [r[0] for r in sorted((r for r in rows if r[1] == user), key=lambda r: (-r[2].timestamp(), r[0]))[:7]]
    assert len(last) == 5


def test_replay_in_rounds(spark, tmp_path):
    """Two rounds over a table give each row twice, in order of time, across a restart."""
    rng = np.random.default_rng(3)
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=int(m)), int(k), int(k % 3)) for k, m in enumerate(rng.permutation(37) // 2)]
    table = spark.createDataFrame(rows, "timestamp timestamp, id long, n int").repartition(4)
    seen = []

    def keep(batch, number):
        seen.append((number, sorted((r["round"], r["row"], r["id"]) for r in batch.collect())))

    def run(until):
        stream = live.replay_rounds(spark, table, ["timestamp", "id"], f"{tmp_path}/numbered", 10, rounds=2)
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            for _ in range(600):
                if len({n for n, _ in seen}) >= until or not query.isActive:
                    break
                query.awaitTermination(0.2)
        finally:
            query.stop()

    run(3)
    first = len(seen)
    run(12)
    assert len(seen) > first >= 3
    batches = dict(seen)  # a batch that was cut off comes again under its number, with the same rows
    assert all(batches[n] == own or len(own) < len(batches[n]) for n, own in seen)
    flat = [x for n in sorted(batches) for x in batches[n]]
    order = [k for _, k, _ in sorted(rows)]
    assert flat == [(r, k, order[k]) for r in range(2) for k in range(37)]


def sending(folder):
    """Notes what it gets; once 25 messages are through it refuses more, until a file says that all is well again."""

    def send(messages):
        import os
        import uuid

        if sum(int(x.split("-")[1]) for x in os.listdir(f"{folder}/got")) >= 25 and not os.path.exists(f"{folder}/well"):
            raise OSError("full")
        with open(f"{folder}/got/m-{len(messages)}-{uuid.uuid4().hex}", "w") as out:
            out.write("\n".join(messages))

    return send


def test_messages_are_delivered_once(spark, tmp_path):
    import json

    (tmp_path / "got").mkdir()
    for part in range(2):
        rows = [(part * 60 + k, f"m{k}") for k in range(60)]
        spark.createDataFrame(rows, "id long, name string").repartition(4).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = live.replay(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_trigger=4)
        sink = live.post_once(sending(str(tmp_path)), f"{tmp_path}/ledger", ["id"], batch_rows=5, attempts=2, pause=0.01)
        live.write_available(stream, f"{tmp_path}/state").foreachBatch(sink).start().awaitTermination()

    def got():
        return [json.loads(line)["id"] for x in (tmp_path / "got").iterdir() for line in x.read_text().splitlines()]

    with pytest.raises(Exception, match="refused"):
        run()
    assert 25 <= len(got()) < 60
    with pytest.raises(Exception, match="refused"):
        run()
    (tmp_path / "well").touch()
    run()
    assert sorted(got()) == list(range(120))
    run()
    assert len(got()) == 120


def test_day_sessions_of_users_in_one_bucket(spark, tmp_path):
    """Users who share a key of state, in two runs: fewer keys than user-days, and the numbers of the batch."""
    rows, source, out = events(7, 150), f"{tmp_path}/in", f"{tmp_path}/out"
    timers = []
    for part in (rows[:70], [*rows[70:], ("end", "zz", datetime(2024, 4, 1), "HTTP")]):
        fed(spark, source, [part])
        stream = state.day_sessions(live.replay(spark, source, spark.read.schema(SCHEMA).parquet(source).schema), buckets=2)
        query = live.write_available(stream, f"{tmp_path}/state").foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).start()
        query.awaitTermination()
        timers += [p["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) for p in query.recentProgress if p["stateOperators"]]
    names = ["id", "user", "timestamp", "date", "event_type", "session", "place"]
    expected = sequences.sessions(spark.createDataFrame(rows, SCHEMA).withColumn("date", F.to_date("timestamp")))
    got = sorted(map(str, spark.read.parquet(out).select(names).collect()))
    assert got == sorted(map(str, expected.select(names).collect())) and len(got) == 150
    assert 0 < max(timers) <= 2
