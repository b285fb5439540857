"""Each user-day as a sequence of 16 numbers an event, cut or padded to 512.

What a loop would carry along is running windows here: sessions by a running sum of starts, device state by the last
non-null value of the machine, type counts by running sums. Windows share their sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeops
from ..session import checkpointed
from .shaping import diagonal, small

MAX_EVENTS = 512
GAP_MINUTES = 30
LONGEST_SESSION = 14_400
# Codes of event types, site categories and file operations.
TYPES = "logon logoff connect disconnect open write copy delete email http file other".split()
SITES = {"na": 0, "none": 0, "": 0, "business": 1, "webmail": 2, "social": 3, "streaming": 4, "gaming": 5, "shopping": 6, "news": 7, "entertainment": 8, "technology": 9, "other": 10}
OPERATIONS = "none open write copy delete".split()
# End of fixed values.
FEATURES = (
    "event_type pc hour day_of_week working_hours weekend after_hours session_progress device_connected file_operation email_sent removable_access "
    "url_category activity_density temporal_entropy session_event_count"
).split()
DAY = ["user", "date"]
SESSION = [*DAY, "session"]


def coded(column: Column, codes: dict[str, int], other: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.lower(column)], F.lit(other))


def type_code(column: Column) -> Column:
    return coded(column, {t: k for k, t in enumerate(TYPES)}, len(TYPES) - 1)


def operation_code(column: Column) -> Column:
    return F.coalesce(coded(column, {t: k for k, t in enumerate(OPERATIONS)}, 0), F.lit(0))


def site_code(column: Column) -> Column:
    """0 for none and for `other`."""
    return F.when(column.isNull() | (F.lower(column) == "other"), F.lit(0)).otherwise(coded(column, SITES, SITES["other"]))


def unified(logs: dict[str, DataFrame]) -> DataFrame:
    """All logs with event_type, pc, is_removable, operation_type and domain_category; missing columns are null."""
    c = F.col
    own = {
        "logon": lambda d: d.withColumn("event_type", c("activity")), "device": lambda d: d.withColumn("event_type", c("activity")),
        "file": lambda d: d.withColumn("event_type", F.when(c("operation_type").isNull(), "File").otherwise(F.initcap("operation_type")) if "operation_type" in d.columns else F.lit("File")),
        "email": lambda d: d.withColumn("event_type", F.lit("Email")), "http": lambda d: d.withColumn("event_type", F.lit("HTTP")),
    }
    wanted = ["id", "user", "pc", "timestamp", "date", "event_type", "is_removable", "operation_type", "domain_category"]
    frames = [own[name](df).withColumn("id", c("id").cast("string")) for name, df in logs.items()]
    out = diagonal([f.select(*[x for x in wanted if x in f.columns]) for f in frames])
    return out.select(*[c(x) if x in out.columns else F.lit(None).cast("boolean" if x == "is_removable" else "string").alias(x) for x in wanted])


def sessions(events: DataFrame, gap_minutes: int = GAP_MINUTES, logoff_starts: bool = False) -> DataFrame:
    """events with session: it grows at each logon, and behind a gap of more than so many minutes in the same day."""
    w = Window.partitionBy(*DAY).orderBy("timestamp", "id")
    starts = F.coalesce(F.lower("event_type").isin("logon", *(["logoff"] if logoff_starts else [])), F.lit(False))
    gap = timeops.seconds_between(F.lag("timestamp").over(w), F.col("timestamp"))
    opens = (starts | (F.coalesce(gap, F.lit(0)) > gap_minutes * 60)).cast("int")
    return events.withColumn("opens", opens).withColumn("session", F.sum("opens").over(w).cast("int")).withColumn("place", F.row_number().over(w)).drop("opens")


def pc_codes(events: DataFrame) -> DataFrame:
    """pc and its number by first encounter over (user, date, time)."""
    first = events.groupBy("pc").agg(F.min(F.struct("user", "date", "timestamp", "id")).alias("first"))
    return first.select("pc", (F.row_number().over(Window.orderBy("first", "pc")) - 1).alias("pc_code"))  # a row for each machine


def entropy(counts: list[Column], total: Column) -> Column:
    """Shannon entropy in bits of running counts."""
    part = lambda n: F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(0.0)
    return F.when(total > 1, sum((part(n) for n in counts[1:]), part(counts[0]))).otherwise(0.0)


def features(events: DataFrame, gap_minutes: int = GAP_MINUTES, max_events: int = MAX_EVENTS, totals: bool = False) -> DataFrame:
    """One row an event, up to max_events a user-day: its place, session and the 16 features by name. totals: also the
    whole day's event_count and session_count."""
    c = F.col
    # machines are numbered once and written; a dimension goes to the events, not they to it
    rows = sessions(events, gap_minutes).join(small(checkpointed(pc_codes(events))), "pc", "left").withColumn("code", type_code(c("event_type")))
    order = ["timestamp", "id"]
    run = Window.partitionBy(*SESSION).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    machine = Window.partitionBy(*DAY, "pc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole_day = Window.partitionBy(*DAY)
    state = F.when(c("code") == 2, F.lit(1)).when(c("code") == 3, F.lit(0))
    rows = rows.withColumns(
        {
            "n": F.row_number().over(Window.partitionBy(*SESSION).orderBy(*order)), "began": F.min("timestamp").over(run),
            "removable": F.max(F.coalesce(c("is_removable"), F.lit(False)).cast("int")).over(run), "connected": F.coalesce(F.last(state, ignorenulls=True).over(machine), F.lit(0)),
        }
        | {f"n_{k}": F.sum((c("code") == k).cast("int")).over(run) for k in range(len(TYPES))}
        | ({"event_count": F.count(F.lit(1)).over(whole_day).cast("int"), "session_count": F.max("session").over(whole_day)} if totals else {})
    )
    elapsed = F.when(c("session") > 0, timeops.seconds_between(c("began"), c("timestamp"))).otherwise(0)
    t = c("timestamp")
    flag = lambda x: x.cast("double")
    values = [
        c("code"), c("pc_code"), timeops.hour_share(t), timeops.day_share(t), flag(timeops.is_office_hour(t)), flag(timeops.is_weekend(t)), flag(timeops.is_night(t)),
        F.when(c("n") == 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), elapsed / LONGEST_SESSION)), c("connected"), operation_code(c("operation_type")), flag(c("code") == TYPES.index("email")),
        c("removable"), site_code(c("domain_category")), (c("n") - 1) / F.greatest(F.lit(1.0), elapsed / 60), entropy([c(f"n_{k}") for k in range(len(TYPES))], c("n")), c("n"),
    ]
    kept = rows.where(c("place") <= max_events)
    return kept.select("user", "date", "id", "timestamp", "place", "session", *(["event_count", "session_count"] if totals else []), *[v.cast("double").alias(f"f_{name}") for v, name in zip(values, FEATURES, strict=True)])


def encoded(events: DataFrame, labels: DataFrame | None = None, max_events: int = MAX_EVENTS) -> DataFrame:
    """user, date, sequence (max_events by 16), seq_len, window_id, session_count, event_count and label."""
    rows = features(events, max_events=max_events, totals=True)
    vector = F.array(*[f"f_{x}" for x in FEATURES])
    packed = F.transform(F.array_sort(F.collect_list(F.struct("place", vector.alias("v")))), lambda x: x.v)  # max_events at most
    out = rows.groupBy(*DAY).agg(packed.alias("sequence"), F.count(F.lit(1)).cast("int").alias("seq_len"), F.first("session_count").alias("session_count"), F.first("event_count").alias("event_count"))
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * len(FEATURES)), F.lit(max_events) - F.col("seq_len"))
    out = out.withColumn("sequence", F.concat("sequence", zeros)).withColumn("window_id", F.concat_ws("_", "user", F.date_format("date", "yyyyMMdd")))
    if labels is None:
        return out.withColumn("label", F.lit(0))
    return out.join(labels.select("user", F.lit(1).alias("label")).distinct(), "user", "left").fillna(0, ["label"])


def summary(encoded_days: DataFrame) -> DataFrame:
    return encoded_days.agg(F.count(F.lit(1)).alias("days"), F.avg("seq_len").alias("mean_len"), F.max("seq_len").alias("max_len"), F.sum("label").alias("positive"))


