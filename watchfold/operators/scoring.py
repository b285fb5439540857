"""Risk rules, alerts, and anomaly scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shaping import min_max, rank_percentile

# Thresholds and weights of the rules.
RISK_RULES = (
    ("after_hours_ratio", 0.3, 0.2), ("logon_count", 10, 0.15), ("device_events", 2, 0.15), ("emails_sent", 15, 0.1), ("is_security_role", 0, 0.1), ("high_after_hours", 0, 0.2),
)
LEVELS = ((0.8, "critical"), (0.6, "high"), (0.4, "medium"), (0.2, "low"))
ALERT_RULES = (
    ("after_hours", "after_hours_ratio", 0.3), ("high_volume", "logon_count", 10), ("device", "device_events", 2), ("email", "emails_sent", 15),
    ("http", "http_requests", 100), ("security", "is_security_role", 0), ("sequence", "high_after_hours", 0),
)
# End of fixed values.
ALERTS = {
    "after_hours": "Activity outside working hours", "high_volume": "Unusually many logons", "device": "Removable devices in use", "email": "Unusually much mail",
    "http": "Unusually many web requests", "security": "Security role active", "sequence": "Pattern of late work",
}


def number(df: DataFrame, name: str) -> Column:
    """A feature as a double; 0 where it is missing."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def risk(df: DataFrame, base: float | Column = 0.0) -> DataFrame:
    """df with threat_score (rules, capped at 1), risk_score (of 100), threat_level and is_threat. base: what is added, such as rand(seed) * 0.3."""
    score = (base if isinstance(base, Column) else F.lit(float(base)))
    for name, over, weight in RISK_RULES:
        score = score + F.when(number(df, name) > over, F.lit(weight)).otherwise(0.0)
    score = F.round(F.least(score, F.lit(1.0)), 10)
    level = None
    for over, name in LEVELS:
        level = F.when(F.col("threat_score") > over, name) if level is None else level.when(F.col("threat_score") > over, name)
    return df.withColumn("threat_score", score).withColumns(
        {"risk_score": F.round(F.col("threat_score") * 100).cast("int"), "threat_level": level.otherwise("normal"), "is_threat": F.col("threat_score") > 0.5}
    )


def alerts(df: DataFrame) -> DataFrame:
    """df with alerts (names of the rules that hold, in order), primary_alert and log_type."""
    names = F.array_compact(F.array(*[F.when(number(df, column) > over, F.lit(name)) for name, column, over in ALERT_RULES]))
    texts = F.create_map(*[F.lit(x) for pair in ALERTS.items() for x in pair])
    kind = F.when(number(df, "logon_count") > 0, "logon").when(number(df, "device_events") > 0, "device").when(number(df, "emails_sent") > 0, "email").when(number(df, "http_requests") > 0, "http").otherwise("process")
    return df.withColumns({"alerts": names, "log_type": kind}).withColumn("primary_alert", F.coalesce(texts[F.get("alerts", F.lit(0))], F.lit("Normal behavior pattern")))


def late_flags(df: DataFrame) -> DataFrame:
    """high_after_hours and mails a logon."""
    rate = F.least(number(df, "emails_sent") / (number(df, "logon_count") + 1), F.lit(100.0))
    return df.withColumns({"high_after_hours": (number(df, "after_hours_ratio") > 0.3).cast("int"), "email_per_logon": rate})


def indicators(df: DataFrame) -> Column:
    """The rules that hold, each with the value that it judged: name=value."""
    said = lambda name, column, over: F.when(number(df, column) > over, F.concat(F.lit(f"{name}="), F.round(number(df, column), 2).cast("decimal(18,2)").cast("string")))
    return F.array_compact(F.array(*[said(*rule) for rule in ALERT_RULES]))


def resource(df: DataFrame) -> Column:
    """What kind of thing the event touched."""
    kinds = {"logon": "workstation", "device": "removable media", "email": "mailbox", "http": "web"}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("log_type")], F.lit("process"))


def messages(df: DataFrame, source: str) -> DataFrame:
    """Rows as event messages: who, when, what, where, the rules that hold with their values, and raw features.

    What a random draw chose is taken from a digest of the user.
    """
    digits = lambda a, n: F.conv(F.substring(F.md5(F.col("user").cast("string")), a, n), 16, 10).cast("long")
    raw = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in df.columns]))
    return df.select(
        F.concat_ws("-", F.lit("LOG"), F.col("date").cast("string"), F.substring(F.md5(F.col("user").cast("string")), 1, 8)).alias("id"), F.col("date").cast("timestamp_ntz").alias("timestamp"), F.col("log_type").alias("logType"), F.substring("user", 1, 12).alias("userId"),
        F.concat(F.lit("User_"), F.substring("user", 1, 6)).alias("userName"), F.col("primary_alert").alias("action"), F.lit(source).alias("sourceFile"),
        (F.col("department") if "department" in df.columns else F.lit("unknown")).alias("department"),
        F.concat(F.lit("192.168."), (digits(1, 2) % 255).cast("string"), F.lit("."), (digits(3, 2) % 255).cast("string")).alias("sourceIp"),
        F.concat(F.lit("SES-"), (digits(5, 6) % 1_000_000).cast("string")).alias("sessionId"), resource(df).alias("resource"), indicators(df).alias("anomalyFactors"),
        F.concat_ws(" ", F.col("primary_alert"), F.concat(F.lit("("), F.size("alerts").cast("string"), F.lit(" rules)"))).alias("details"), raw.alias("rawFeatures"), "alerts",
    )


def level_counts(df: DataFrame) -> DataFrame:
    """One row: events by level, alerts, and the rounded mean risk."""
    of = lambda name: F.count(F.when(F.col("threat_level") == name, 1)).alias(f"n_{name}")
    return df.agg(*[of(x) for x in ("critical", "high", "medium", "low", "normal")], F.count(F.when(F.col("is_threat"), 1)).alias("new_alerts"), F.round(F.avg("risk_score")).cast("long").alias("avg_risk"))


def scaled_vectors(df: DataFrame, columns: list[str] | None = None, vector: str | None = None, out: str = "scaled") -> DataFrame:
    """A vector of columns (or an array), each entry less its mean and by its standard deviation over all rows (ddof 0)."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import array_to_vector

    if vector:
        raw = df.withColumn("__raw", array_to_vector(F.transform(vector, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))))
    else:
        raw = VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="keep").transform(df.fillna(0.0, columns))
    n = raw.count()
    model = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True).fit(raw)
    from pyspark.ml.functions import vector_to_array

    ratio = float(np.sqrt(n / (n - 1))) if n > 1 else 1.0
    return model.transform(raw).withColumn(out, F.transform(vector_to_array("__scaled"), lambda x: x * ratio)).drop("__raw", "__scaled")


def ensemble(df: DataFrame, iso: str = "iso_forest_score", pca: str = "pca_recon_error", key: str = "user") -> DataFrame:
    """The weighted sum of normalised scores, and its place in the ranking. Learned scores that df lacks are stood in for by multiples of the others."""
    stand_in = {"autoencoder_recon_error": F.col(pca) * 1.5, "deep_svdd_distance": F.abs(iso) * 0.8}
    scored = df.withColumns({name: value for name, value in stand_in.items() if name not in df.columns})
    names = [iso, pca, "deep_svdd_distance"]
    total = sum(w * F.col(f"{c}_norm") for w, c in zip((0.3, 0.3, 0.4), names, strict=True))
    out = min_max(scored, names).withColumn("ensemble_anomaly_score", total).drop(*[f"{c}_norm" for c in names])
    return rank_percentile(out, "ensemble_anomaly_score", key)


def weighted_ensemble(df: DataFrame, columns: tuple[str, str, str], weights: tuple[float, float, float] = (0.3, 0.3, 0.4)) -> DataFrame:
    """Raw scores weighed, then moved to 0..1 if any is above 0."""
    raw = df.withColumn("raw_score", sum(w * F.col(c) for w, c in zip(weights, columns, strict=True)))
    ends = raw.agg(F.min("raw_score").alias("__a"), F.max("raw_score").alias("__b"))
    moved = F.when(F.col("__b") > 0, (F.col("raw_score") - F.col("__a")) / (F.col("__b") - F.col("__a") + 1e-8)).otherwise(F.col("raw_score"))
    return raw.crossJoin(F.broadcast(ends)).withColumn("score", moved).drop("__a", "__b")  # ends: one row


def model_scores(df: DataFrame, columns: list[str], predict, mean: list[float], scale: list[float], threshold: float = 0.5) -> DataFrame:
    """df with probability and is_threat of a model: predict(matrix) -> logits (rows by 2). NaN counts as 0; (x - mean) / scale."""
    centre, spread = np.array(mean), np.array(scale)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logits = np.asarray(predict((np.nan_to_num(batch[columns].to_numpy(float)) - centre) / spread), float)
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            p = e[:, 1] / e.sum(axis=1)
            yield batch.assign(probability=p, is_threat=p > threshold)

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("probability", T.DoubleType()), T.StructField("is_threat", T.BooleanType())])
    return df.mapInPandas(run, schema)
