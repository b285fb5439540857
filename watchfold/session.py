"""Spark sessions, and the library's way to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(master: str = "local[*]", shuffle_partitions: int = 8, **config: str) -> SparkSession:
    """A session with UTC and adaptive execution, for tests and single machines; on a cluster use the one given."""
    builder = SparkSession.builder.master(master).appName("watchfold")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=settings | config).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each application. Spark serves the file itself."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Where none is set, a local session makes one; a cluster has to name it."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return checkpoint_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read back, which cuts its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def file_size(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file, or of all files in a folder, in any store that Spark reads; None where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getContentSummary(where).getLength() if store.exists(where) else None


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
