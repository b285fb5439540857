"""Declared schemas of the raw tables, a registry, and checks of columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names.split()]


def longs(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names.split()]


@dataclass(frozen=True)
class Source:
    name: str
    schema: T.StructType
    key: str
    #: Average bytes of a row as text, for estimates.
    row_bytes: int = 150


# Names, order and keys of the raw tables' columns, which files must have.
SOURCES = {
    s.name: s
    for s in (
        Source("logon", T.StructType(strings("id date user pc activity")), "id", 60),
        Source("device", T.StructType(strings("id date user pc activity")), "id", 60),
        Source("file", T.StructType(strings("id date user pc filename content")), "id", 200),
        Source("email", T.StructType(strings("id date user pc to cc bcc from") + longs("size attachments") + strings("content")), "id", 180),
        Source("http", T.StructType(strings("id date user pc url content")), "id", 250),
        Source("ldap", T.StructType(strings("employee_name user_id email role projects business_unit functional_unit department team supervisor")), "user_id"),
        Source("psychometric", T.StructType(strings("employee_name user_id") + longs("O C E A N")), "user_id"),
        Source("ground_truth", T.StructType([T.StructField("dataset", T.DoubleType()), *longs("scenario"), *strings("details user start end")]), "user"),
    )
}
LOGS = ("logon", "device", "file", "email", "http")
#: Columns that readers add and validation allows.
DERIVED = set(
    "timestamp hour day_of_week week month year date is_weekend is_working_hours is_after_hours is_holiday user_hash pc_hash is_removable file_extension "
    "file_header to_count cc_count bcc_count sender sender_domain is_internal_sender has_attachments has_external_recipient domain url_path snapshot_month "
    "is_it_admin is_manager is_high_risk is_disagreeable is_disagreeable_wide".split()
)
EVENT_TYPES = ("Logon", "Logoff", "Connect", "Disconnect", "Open", "Write", "Copy", "Delete", "Email", "HTTP", "File", "Other")
RISK_LEVELS = ("normal", "low", "medium", "high", "critical")


class ColumnsError(ValueError):
    """Columns are missing."""


def column_check(df: DataFrame, source: str, strict: bool = False) -> dict[str, list[str]]:
    """Missing and unexpected columns; strict: missing ones raise."""
    expected = set(SOURCES[source].schema.names)
    out = {"missing": sorted(expected - set(df.columns)), "extra": sorted(set(df.columns) - expected - DERIVED)}
    if strict and out["missing"]:
        raise ColumnsError(f"{source}: missing {', '.join(out['missing'])}")
    return out


def range_check(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """One row: for each column how many values are outside."""
    outside = lambda c: (F.col(c) < low) | (F.col(c) > high)
    return df.agg(*[F.count(F.when(outside(c), 1)).alias(c) for c in columns])


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with the columns it lacks, in one projection."""
    return df.select("*", *[v.alias(k) for k, v in defaults.items() if k not in df.columns])
