"""Labels from intervals, and the user-day spine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import days_between
from .shaping import first_of

UD = ["user", "date"]


def spine(users: DataFrame, start: str | None = None, end: str | None = None, over: DataFrame | None = None) -> DataFrame:
    """Every user on every day, of a period or of the days that `over` spans."""
    period = (over.agg(F.min("date").alias("a"), F.max("date").alias("b")) if over is not None else users.sparkSession.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b")))
    days = period.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    return users.select("user").distinct().crossJoin(F.broadcast(days))  # days: those of a calendar


def expanded(intervals: DataFrame) -> DataFrame:
    """A label for each user and day of an interval; of several the one of the least scenario."""
    days = days_between(intervals, "start", "end").select("user", "date", F.col("scenario").cast("string").alias("threat_type"))
    return days.groupBy(*UD).agg(F.min("threat_type").alias("threat_type"))


def labelled(days: DataFrame, intervals: DataFrame) -> DataFrame:
    """days with is_insider and threat_type ('none' for benign days), by expansion and equal keys."""
    out = days.join(expanded(intervals), UD, "left")
    return out.select(*days.columns, F.col("threat_type").isNotNull().cast("smallint").alias("is_insider"), F.coalesce("threat_type", F.lit("none")).alias("threat_type"))


def labelled_by_range(days: DataFrame, intervals: DataFrame) -> DataFrame:
    """The same by a range join: user and start <= date <= end; of several intervals the one that starts first."""
    spans = intervals.select(F.col("user").alias("u"), "start", "end", "scenario")
    met = days.join(spans, (F.col("user") == F.col("u")) & F.col("date").between(F.col("start"), F.col("end")), "left")
    one = first_of(met, UD, [F.col("start").asc_nulls_last(), F.col("scenario")])
    return one.select(*days.columns, F.col("scenario").isNotNull().cast("smallint").alias("is_insider"), F.coalesce(F.col("scenario").cast("string"), F.lit("none")).alias("threat_type"))


def attached(features: DataFrame, labels: DataFrame) -> DataFrame:
    """features with labels, benign where there are none."""
    return features.join(labels, UD, "left").fillna({"is_insider": 0, "threat_type": "none"})
