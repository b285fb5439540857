"""The live path: replayed files, enrichment, alerts, windows. The same functions serve batch tables and streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.scoring import alerts, late_flags, risk
from ..operators.shaping import rank_percentile
from ..session import checkpointed


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    """A folder's files as a stream, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def replay_rounds(spark: SparkSession, rows: DataFrame, order: list[str], folder: str, rows_per_batch: int = 1000, rounds: int | None = None) -> DataFrame:
    """A bounded table's rows as a stream in order, round and round, with round (from 0) and row (the place in order, from 0).

    The rows are numbered once, by range partitions, and kept under their numbers in folder, which a restart finds again.
    Each batch takes the next rows_per_batch numbers from a counter whose offsets the stream's checkpoint keeps: a batch
    that is repeated has the same rows, and (round, row) grows from batch to batch. rounds: so many, then batches are empty.
    """
    try:
        numbered = spark.read.parquet(folder)
    except AnalysisException:
        placed = rank_percentile(rows.withColumn("__order", F.struct(*order)).withColumn("__one", F.xxhash64(*rows.columns)), "__order", "__one", "__share")
        placed = checkpointed(placed)
        n = placed.count()
        placed.withColumn("row", F.round(F.col("__share") * n).cast("long")).drop("__order", "__one", "__share").repartitionByRange("row").sortWithinPartitions("row").write.parquet(folder)
        numbered = spark.read.parquet(folder)
    n = max(1, numbered.count())
    counter = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", 1).load()
    due = counter.select(F.col("value"), F.floor(F.col("value") / n).cast("long").alias("round"), (F.col("value") % n).alias("row"))
    due = due if rounds is None else due.where(F.col("round") < rounds)
    return numbered.join(F.broadcast(due.drop("value")), "row")  # a batch has rows_per_batch numbers


def enrich(events: DataFrame) -> DataFrame:
    """Feature rows with risk, level and alerts; without state."""
    return alerts(risk(late_flags(events)))


def threats(events: DataFrame) -> DataFrame:
    return events.where("is_threat")


def windowed_counts(events: DataFrame, ts: str = "timestamp", keys: tuple[str, ...] = ("kind",), length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by window; events later than `late` are dropped by streams."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", *keys, "n")


def session_windows(events: DataFrame, ts: str = "timestamp", key: str = "user", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by event time: events less than the gap apart are one."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", key, "n")


def once(events: DataFrame, keys: list[str], ts: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """Without events that come again within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def recent(path: str, order: str, k: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table of the k latest rows, kept in two folders that take turns."""

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now, then = f"{path}/{number % 2}", f"{path}/{(number + 1) % 2}"
        both = batch.unionByName(spark.read.parquet(then)) if number else batch
        both.orderBy(F.desc(order)).limit(k).write.mode("overwrite").parquet(now)

    return keep


def to_url(url: str, timeout: float = 5.0) -> Callable[[list[str]], None]:
    """A sender that posts messages as a JSON array; a refusal raises."""

    def send(messages: list[str]) -> None:
        from urllib.request import Request, urlopen

        request = Request(url, data=f"[{','.join(messages)}]".encode(), headers={"Content-Type": "application/json"}, method="POST")
        with urlopen(request, timeout=timeout) as answer:
            if answer.status >= 300:
                raise OSError(f"{url} answered {answer.status}")

    return send


def post(send: Callable[[list[str]], None], batch_rows: int = 1000, attempts: int = 3, pause: float = 5.0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands JSON messages to send, in groups, on the executors.

    A send that fails with an OSError is tried again behind a pause. The last failure fails the task, and with it the
    batch, which the stream's checkpoint then repeats: delivery is at least once.
    """

    def insist(messages: list[str]) -> None:
        for attempt in range(attempts):
            try:
                return send(messages)
            except OSError:
                if attempt + 1 == attempts:
                    raise
                time.sleep(pause)

    def deliver(batch: DataFrame, _: int) -> None:
        def each(rows) -> None:
            held = []
            for row in rows:
                held.append(row[0])
                if len(held) == batch_rows:
                    insist(held)
                    held = []
            if held:
                insist(held)

        batch.select(F.to_json(F.struct("*"))).foreachPartition(each)

    return deliver


def post_once(send: Callable[[list[str]], None], ledger: str, keys: list[str], batch_rows: int = 1000, attempts: int = 3, pause: float = 5.0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: as post, but a batch that is repeated leaves out what its earlier runs have delivered.

    ledger: a folder of the shared store, with the keys of each batch's delivered messages. A group that is refused does
    not fail its task: the task goes on to report what it has delivered and what it has not, the delivered keys are
    written to the ledger, and only then does the batch fail, to be repeated without them. So a message is delivered
    once, but for the groups of an executor that is lost between sending and reporting, which are sent again.
    Messages of one batch with equal keys are one message.
    """

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken = ""
        for batch in batches:
            for a in range(0, len(batch), batch_rows):
                own = batch[a : a + batch_rows]
                for attempt in range(attempts if not broken else 0):
                    try:
                        send(own["message"].tolist())
                        broken = ""
                        break
                    except OSError as error:
                        broken = str(error) or type(error).__name__
                        if attempt + 1 < attempts:
                            time.sleep(pause)
                yield pd.DataFrame({"key": own["key"], "refused": [broken or None] * len(own)})

    def deliver(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{ledger}/batch={number}"
        messages = batch.select(F.to_json(F.struct(*keys)).alias("key"), F.to_json(F.struct("*")).alias("message")).dropDuplicates(["key"])
        try:
            messages = messages.join(spark.read.schema("key string").parquet(folder), "key", "left_anti")
        except AnalysisException:
            pass
        told = checkpointed(messages.mapInPandas(groups, "key string, refused string"))  # each message is sent by this one job
        told.where("refused IS NULL").select("key").write.mode("append").parquet(folder)
        failed = told.where("refused IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.max("refused").alias("why")).first()
        if failed["n"]:
            raise OSError(f"{failed['n']} messages of batch {number} were refused: {failed['why']}")

    return deliver


def write_available(events: DataFrame, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """A writer that takes what is there and stops; restarts go on from the checkpoint."""
    return events.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
