"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, checkpointed, discard  # noqa: F401

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a side up to which it is sent to all executors.
BROADCAST_BYTES = 64 << 20
#: Rows of text or of sets that Spark hands to a Python worker at once.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let this session hand Python workers BATCH_ROWS rows at once at most, where it would hand more: a whole split of texts
    is held several times over, by the worker and outside the executor's heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written as Parquet to the checkpoint folder and read back, and its folder, to be discarded when it is done with."""
    folder = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder), folder


def sent(df: DataFrame, row_bytes: int, extra: Column | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows, of row_bytes and extra bytes each, are within the limit."""
    size = df.agg(F.coalesce(F.sum(F.lit(row_bytes) + (F.lit(0) if extra is None else extra)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased, other letters as they are. Only words with others take the slower way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All of a frame's columns as one struct, so that their names cannot clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def text_key(text: Column) -> list[Column]:
    """128 bits that identify a text, as two longs th1 and th2."""
    filled = F.coalesce(text, F.lit(""))
    return [F.xxhash64(filled).alias("th1"), F.xxhash64(F.lit(7), filled).alias("th2")]
