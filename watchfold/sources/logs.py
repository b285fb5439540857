"""Readers of the raw CSV tables, and of what they were turned into."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, timeops
from ..functions.hashing import SALT, pseudonymise
from ..session import file_size
from .schemas import LOGS, SOURCES

#: Holds the line as it stands where it does not fit the schema, and its file.
RAW_LINE, RAW_FILE = "__raw_line", "__raw_file"


def read_csv(spark: SparkSession, path: str, source: str, multi_line: bool = False, keep_raw: bool = False) -> DataFrame:
    """A raw table by its declared schema; lines that do not fit give nulls, and stand in RAW_LINE where it is asked for.

    multi_line: quoted fields may hold line feeds. Such files cannot be split, and each is read by one task.
    """
    schema = SOURCES[source].schema
    reader = spark.read.option("recursiveFileLookup", "true")
    if not keep_raw:
        return reader.schema(schema).csv(path, header=True, multiLine=multi_line, escape='"', mode="PERMISSIVE")
    # without column pruning, so that what fits does not depend on which columns are asked for
    reader = reader.schema(T.StructType([*schema.fields, T.StructField(RAW_LINE, T.StringType())])).option("columnPruning", "false")
    df = reader.csv(path, header=True, multiLine=multi_line, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=RAW_LINE)
    return df.withColumn(RAW_FILE, F.input_file_name())


def without_rejects(df: DataFrame) -> DataFrame:
    """The rows whose lines fit."""
    return df.where(F.col(RAW_LINE).isNull()).drop(RAW_LINE, RAW_FILE) if RAW_LINE in df.columns else df


def rejects(df: DataFrame, source: str) -> DataFrame:
    """file, line and reason of each line that does not fit (its number of fields, or the columns whose values are of another type), and how many of its columns were filled."""
    fields = SOURCES[source].schema.fields
    line = F.col(RAW_LINE)
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")
    n = F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1
    typed = [f.name for f in fields if not isinstance(f.dataType, T.StringType)]
    wrong = F.concat_ws(", ", *[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in typed])
    filled = sum((F.col(f"`{f.name}`").isNotNull().cast("int") for f in fields), F.lit(0))
    reason = F.when(n != len(fields), F.concat(F.lit("fields: "), n.cast("string"))).otherwise(F.concat(F.lit("values: "), wrong))
    return df.where(line.isNotNull()).select(F.col(RAW_FILE).alias("file"), line.alias("line"), reason.alias("reason"), filled.alias("filled"))


def timed(df: DataFrame, as_written: bool = False) -> DataFrame:
    """timestamp from the raw date, and the calendar columns (date becomes a date)."""
    return timeops.calendar(df.withColumn("timestamp", timeops.parse_timestamp(F.col("date"))), as_written=as_written)


def enriched(df: DataFrame, source: str) -> DataFrame:
    """The columns that a source's reader adds."""
    c = F.col
    if source == "file":
        return df.withColumns({"is_removable": text.is_removable(c("filename")), "file_extension": text.file_extension(c("filename")), "file_header": text.file_header(c("content"))})
    if source == "email":
        counts = {f"{x}_count": F.coalesce(text.recipient_count(c(x)), F.lit(0)).cast("long") for x in ("to", "cc", "bcc")}
        return df.withColumns(
            counts
            | {
                "sender": F.trim(c("from")), "sender_domain": text.sender_domain(c("from")), "is_internal_sender": F.coalesce(text.is_internal(c("from")), F.lit(False)),
                "has_attachments": F.coalesce(c("attachments") > 0, F.lit(False)), "has_external_recipient": text.has_external_recipient(c("to")),
            }
        )
    if source == "http":
        return df.withColumns({"domain": text.url_domain(c("url")), "url_path": text.url_path(c("url"))})
    if source == "psychometric":
        return df.withColumns(text.personality_flags(c("O"), c("C"), c("A"), c("N")))
    if source == "ldap":
        return df.withColumns(text.directory_flags(c("role")))
    return df


def read_log(spark: SparkSession, path: str, source: str, sample_rows: int | None = None, multi_line: bool = False, keep_raw: bool = False) -> DataFrame:
    """One of the five logs, timed and enriched. sample_rows: only so many."""
    raw = read_csv(spark, path, source, multi_line, keep_raw)
    return enriched(timed(raw.limit(sample_rows) if sample_rows else raw), source)


def read_psychometric(spark: SparkSession, path: str, keep_raw: bool = False) -> DataFrame:
    return enriched(read_csv(spark, path, "psychometric", keep_raw=keep_raw), "psychometric")


def read_ldap(spark: SparkSession, folder: str, keep_raw: bool = False) -> DataFrame:
    """All monthly snapshots of a folder, with the month of each from its file's or folder's name."""
    month = timeops.parse_month(text.extracted(F.input_file_name(), r"(\d{4}-\d{2})(?:\.csv|/[^/]*)$"))
    return enriched(read_csv(spark, folder, "ldap", keep_raw=keep_raw).withColumn("snapshot_month", month), "ldap")


def read_ground_truth(spark: SparkSession, path: str | None, release: float | None = None) -> DataFrame:
    """Labelled intervals with their times; without a path, an empty table. release: of one data set alone."""
    raw = read_csv(spark, path, "ground_truth") if path else spark.createDataFrame([], SOURCES["ground_truth"].schema)
    if release is not None:
        raw = raw.where(F.abs(F.col("dataset") - release) < 1e-9)
    return raw.withColumns({"start": timeops.parse_any(F.col("start")), "end": timeops.parse_any(F.col("end"))})


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """user, scenario, start and end of each answer file: first and last time in it; user and scenario from its path."""
    name = F.input_file_name()
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(name.alias("path"), F.split("value", ",").alias("fields"))
    at = timeops.parse_any(F.trim(F.regexp_replace(F.get("fields", F.lit(2)), '"', "")))
    return (
        lines.groupBy("path").agg(F.min(at).alias("start"), F.max(at).alias("end"))
        .select(text.extracted(F.col("path"), r"-([A-Z]{3}\d{4})\.csv$").alias("user"), text.extracted(F.col("path"), r"r\d\.\d-(\d+)").cast("long").alias("scenario"), "start", "end")
        .where("start IS NOT NULL AND user IS NOT NULL")
    )


def read_all(spark: SparkSession, folder: str, http: bool = True, http_sample: int | None = None, directory: bool = True, traits: bool = True, multi_line: bool = False, keep_raw: bool = False) -> dict[str, DataFrame]:
    """All tables of a folder, lazily: the five logs, the directory's snapshots and the personality traits."""
    names = [x for x in LOGS if http or x != "http"]
    out = {x: read_log(spark, f"{folder}/{x}.csv", x, http_sample if x == "http" else None, multi_line, keep_raw) for x in names}
    if directory:
        out["ldap"] = read_ldap(spark, f"{folder}/ldap", keep_raw)
    if traits:
        out["psychometric"] = read_psychometric(spark, f"{folder}/psychometric.csv", keep_raw)
    return out


def read_stage1(spark: SparkSession, folder: str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Tables that stage 1 wrote. Required ones that are not there raise, all named; optional ones are left out."""
    out: dict[str, DataFrame] = {}
    for name in (*required, *optional):
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            continue
    if missing := [x for x in required if x not in out]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return out


def hashed(tables: dict[str, DataFrame], salt: str = SALT) -> dict[str, DataFrame]:
    """All tables with user_hash (and pc_hash), by one rule for all."""
    users = {"user": "user", "pc": "pc"}
    out = {}
    for name, df in tables.items():
        named = df.withColumn("user", F.col("user_id")) if "user" not in df.columns and "user_id" in df.columns else df
        out[name] = pseudonymise(named, users, salt)
    return out


def chronological(tables: dict[str, DataFrame]) -> DataFrame:
    """All logs in one, with source_type and action, in order of time; columns that a log lacks are null."""
    action = {"logon": "activity", "device": "activity", "file": "filename", "email": "to", "http": "url"}
    out = None
    for name, df in tables.items():
        own = df.where("timestamp IS NOT NULL").withColumns({"source_type": F.lit(name), "action": F.col(action[name])})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.orderBy("timestamp", "source_type", "id")


def random_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def with_source(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames of alike columns in one, with the file that each row is from."""
    out = None
    for name, df in frames.items():
        own = df.withColumn("_source_file", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def estimated_rows(spark: SparkSession, path: str, source: str) -> int:
    """Rows of a file or folder in any store, from its size; 0 where there is none."""
    return (file_size(spark, path) or 0) // SOURCES[source].row_bytes


def availability(spark: SparkSession, folder: str) -> dict[str, int | None]:
    """About how many rows of each raw table a folder has, in any store; None for those that are not there."""
    paths = {name: f"{folder}/{name if name == 'ldap' else f'{name}.csv'}" for name in SOURCES}
    return {name: None if file_size(spark, path) is None else estimated_rows(spark, path, name) for name, path in paths.items()}


def load_statistics(df: DataFrame, source: str) -> DataFrame:
    """One row: rows, users, machines, and what counts for the source."""
    yes = lambda c: F.count(F.when(F.col(c), 1)).alias(f"n_{c}")
    more = {
        "logon": [yes("is_after_hours"), yes("is_weekend")], "device": [yes("is_after_hours")], "file": [yes("is_removable")],
        "email": [yes("has_external_recipient"), F.coalesce(F.sum("attachments"), F.lit(0)).alias("attachments")], "http": [F.countDistinct("domain").alias("domains")],
    }
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user").alias("users"), F.countDistinct("pc").alias("pcs"), *more.get(source, []))
