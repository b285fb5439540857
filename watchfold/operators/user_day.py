"""Features of each user and day. One grouped aggregation a source; sessions by one window sort.

`by` is the grain; it defaults to user and date. Counts come from conditional aggregates, so that a user-day with only
logoffs (or only received mail) keeps its row. Ratios are taken after missing counts have become 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, timeops

UD = ["user", "date"]
WINDOWS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90}
# Operations that count as writes, copies and deletes.
WRITES, COPIES, DELETES = ("write", "create"), ("copy", "move"), ("delete", "remove")
# End of fixed values.


def window_days(name: str) -> int:
    if name not in WINDOWS:
        raise ValueError(f"no such window: {name}; known: {', '.join(WINDOWS)}")
    return WINDOWS[name]


def how_many(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def is_(column: str, *values: str) -> Column:
    return F.lower(column).isin(*values)


def logon_counts(logs: DataFrame, by: list[str] = UD) -> DataFrame:
    """Logons, logoffs, logons after hours and at weekends, machines, and logons' share of all."""
    on = is_("activity", "logon")
    out = logs.groupBy(*by).agg(
        how_many(on).alias("logon_count"), how_many(is_("activity", "logoff")).alias("logoff_count"), how_many(on & F.col("is_after_hours")).alias("after_hours_logons"),
        how_many(on & F.col("is_weekend")).alias("weekend_logons"), F.countDistinct(F.when(on, F.col("pc"))).alias("unique_pcs"),
    )
    return out.withColumn("logon_ratio", F.col("logon_count") / (F.col("logon_count") + F.col("logoff_count") + 1))


def logon_intensity(logs: DataFrame, by: list[str] = UD) -> DataFrame:
    """Of all rows: counts, first and last hour, intensity n / (n + 1), and the share after hours."""
    yes = lambda c: F.sum(F.col(c).cast("long"))
    out = logs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("logon_count"), yes("is_after_hours").alias("after_hours_count"), yes("is_weekend").alias("weekend_count"), yes("is_working_hours").alias("working_hours_count"),
        F.countDistinct("pc").alias("unique_pcs"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"),
    )
    n = F.col("logon_count")
    return out.withColumns({"logon_intensity": n / (n + 1), "after_hours_ratio": text.clipped(F.col("after_hours_count") / (n + 1), 0.0, 1.0)})


def session_pairs(logs: DataFrame, start: str, end: str, positive: bool = True) -> DataFrame:
    """The rows of activity `end` whose predecessor on the same user's machine is a `start`, with seconds between."""
    w = Window.partitionBy("user", "pc").orderBy("timestamp", "id")
    rows = logs.withColumns({"prev_activity": F.lag("activity").over(w), "prev_timestamp": F.lag("timestamp").over(w)})
    pairs = rows.where(is_("activity", end) & is_("prev_activity", start)).withColumn("seconds", timeops.seconds_between(F.col("prev_timestamp"), F.col("timestamp")))
    return pairs.where("seconds > 0") if positive else pairs


def session_durations(logs: DataFrame, by: list[str] = UD, start: str = "logon", end: str = "logoff", positive: bool = True) -> DataFrame:
    """avg, max, std (0 for one session), median, sum and number of session seconds."""
    s = F.col("seconds")
    return session_pairs(logs, start, end, positive).groupBy(*by).agg(
        F.avg(s).alias("avg_session"), F.max(s).alias("max_session"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("std_session"),
        F.median(s).alias("median_session"), F.sum(s).alias("sum_session"), F.count(F.lit(1)).alias("sessions"),
    )


def rapid_logons(logs: DataFrame, by: list[str] = UD, seconds: int = 300, logons_only: bool = True) -> DataFrame:
    """Logons less than so many seconds behind the user's last one; with logoffs in between counted too if asked."""
    rows = logs.where(is_("activity", "logon")) if logons_only else logs
    w = Window.partitionBy("user").orderBy("timestamp", "id")
    gap = timeops.seconds_between(F.lag("timestamp").over(w), F.col("timestamp"))
    return rows.withColumn("gap", gap).groupBy(*by).agg(how_many((F.col("gap") < seconds) & is_("activity", "logon")).alias("rapid_logons"))


def logon_day(logs: DataFrame, seconds: int = 300) -> DataFrame:
    """logon_counts, session_durations, rapid_logons and temporal_profile of each user and day from one grouped pass.

    Both predecessors, on the same machine and of the user's last logon, are flags of the rows; the second window deals
    rows by user, and the aggregation needs no other exchange.
    """
    on, ts = is_("activity", "logon"), F.col("timestamp")
    machine, mine = Window.partitionBy("user", "pc").orderBy("timestamp", "id"), Window.partitionBy("user").orderBy("timestamp", "id")
    paired = is_("activity", "logoff") & (F.lower(F.lag("activity").over(machine)) == "logon")
    rows = logs.withColumn("session_seconds", F.when(paired, timeops.seconds_between(F.lag("timestamp").over(machine), ts)))
    before = F.last(F.when(on, ts), ignorenulls=True).over(mine.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("gap", F.when(on, timeops.seconds_between(before, ts)))
    s = F.when(F.col("session_seconds") > 0, F.col("session_seconds"))
    out = rows.groupBy(*UD).agg(
        how_many(on).alias("logon_count"), how_many(is_("activity", "logoff")).alias("logoff_count"), how_many(on & F.col("is_after_hours")).alias("after_hours_logons"),
        how_many(on & F.col("is_weekend")).alias("weekend_logons"), F.countDistinct(F.when(on, F.col("pc"))).alias("unique_pcs"),
        F.avg(s).alias("avg_session"), F.max(s).alias("max_session"), F.when(F.count(s) > 0, F.coalesce(F.stddev_samp(s), F.lit(0.0))).alias("std_session"), F.median(s).alias("median_session"),
        F.sum(s).alias("sum_session"), F.count(s).alias("sessions"), how_many(F.col("gap") < seconds).alias("rapid_logons"),
        *[how_many(F.col("hour") == v).alias(f"hour_{v}") for v in range(24)], *[how_many(F.col("day_of_week") == v).alias(f"day_of_week_{v}") for v in range(7)],
    )
    return out.withColumn("logon_ratio", F.col("logon_count") / (F.col("logon_count") + F.col("logoff_count") + 1))


def device_counts(logs: DataFrame, by: list[str] = UD) -> DataFrame:
    """Connects, disconnects, those after hours and at weekends, machines, and connects that no disconnect answers."""
    on = is_("activity", "connect")
    out = logs.groupBy(*by).agg(
        how_many(on).alias("connect_count"), how_many(is_("activity", "disconnect")).alias("disconnect_count"), how_many(on & F.col("is_after_hours")).alias("after_hours_connects"),
        how_many(on & F.col("is_weekend")).alias("weekend_connects"), F.countDistinct("pc").alias("unique_devices"), F.count(F.lit(1)).alias("device_events"),
    )
    return out.withColumn("missing_disconnect_count", F.greatest(F.col("connect_count") - F.col("disconnect_count"), F.lit(0)))


def file_counts(logs: DataFrame, by: list[str] = UD, large: Column | None = None) -> DataFrame:
    """Events, writes, copies, deletes, removable writes, kinds of files, after hours, and large writes."""
    op, write = (lambda names: is_("operation_type", *names)), is_("operation_type", *WRITES)
    return logs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("file_event_count"), how_many(write).alias("file_write_count"), how_many(op(COPIES)).alias("file_copy_count"), how_many(op(DELETES)).alias("file_delete_count"),
        how_many(F.col("is_removable")).alias("removable_media_writes"), F.countDistinct("file_extension").alias("file_type_diversity"), how_many(F.col("is_after_hours")).alias("after_hours_files"),
        how_many(write & (text.is_large(F.col("content")) if large is None else large)).alias("large_file_writes"),
    )


def email_counts(logs: DataFrame, by: list[str] = UD) -> DataFrame:
    """Mail sent by insiders, received, sent outside; sizes, attachments, domains, contacts and use of copies.

    Domains and contacts are told apart by 64 hashed bits, in one set of each for a user's day, so that rows are neither
    multiplied nor shuffled twice.
    """
    sent = F.col("is_internal_sender")
    outside = sent & F.col("has_external_recipient")
    mine = lambda c: F.when(sent, F.col(c))
    kinds = lambda c: F.size(F.collect_set(c)).cast("long")
    out = logs.groupBy(*by).agg(
        how_many(sent).alias("emails_sent"), how_many(~sent).alias("emails_received"), F.coalesce(F.avg(mine("size")), F.lit(0.0)).alias("avg_email_size"),
        F.coalesce(F.max(mine("size")), F.lit(0)).alias("max_email_size"), F.coalesce(F.sum(mine("attachments")), F.lit(0)).alias("attachment_count"),
        how_many(sent & F.col("has_attachments")).alias("emails_with_attachments"), how_many(sent & F.col("is_after_hours")).alias("after_hours_emails"),
        how_many(outside).alias("external_emails_sent"), kinds(F.when(outside & F.col("sender_domain").isNotNull(), F.xxhash64("sender_domain"))).alias("unique_external_domains"),
        kinds(F.when(F.col("has_external_recipient") & F.col("to").isNotNull(), F.xxhash64("to"))).alias("external_contacts"),
        F.coalesce(F.avg(mine("to_count")), F.lit(0.0)).alias("avg_recipients"), F.coalesce(F.avg(mine("cc_count")), F.lit(0.0)).alias("avg_cc"),
    )
    return out.withColumn("cc_usage_rate", F.least(F.col("avg_cc") / (F.col("emails_sent") + 1), F.lit(1.0)))


def email_totals(logs: DataFrame, by: list[str] = UD) -> DataFrame:
    """Mail by where it goes: all, to insiders alone, outside; attachments, sizes and recipients."""
    outside = F.col("has_external_recipient")
    return logs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("emails_sent"), how_many(~outside).alias("internal_emails"), how_many(outside).alias("external_emails"), how_many(F.col("has_attachments")).alias("emails_with_attachments"),
        F.avg("size").alias("avg_email_size"), F.max("size").alias("max_email_size"), F.sum("size").alias("total_email_size"), F.avg("to_count").alias("avg_recipients"), F.avg("cc_count").alias("avg_cc"),
    )


def http_counts(logs: DataFrame, by: list[str] = UD, words: dict[str, str] = text.SITE_WORDS) -> DataFrame:
    """Requests, domains, those after hours and at weekends, and visits to each group of sites."""
    flags = text.site_flags(F.col("domain"), words)
    return logs.withColumns(flags).groupBy(*by).agg(
        F.count(F.lit(1)).alias("http_request_count"), F.countDistinct("domain").alias("unique_domains"), how_many(F.col("is_after_hours")).alias("after_hours_http"),
        how_many(F.col("is_weekend")).alias("weekend_http"), *[how_many(F.col(f)).alias(f.replace("is_", "") + "_visits") for f in flags],
    )


def histogram(logs: DataFrame, by: list[str], column: str, values: range, prefix: str) -> DataFrame:
    """Rows for each value, a column each."""
    return logs.groupBy(*by).agg(*[how_many(F.col(column) == v).alias(f"{prefix}_{v}") for v in values])


def hour_profile(logs: DataFrame, by: list[str] = UD) -> DataFrame:
    return histogram(logs, by, "hour", range(24), "hour")


def day_profile(logs: DataFrame, by: list[str] = UD) -> DataFrame:
    return histogram(logs, by, "day_of_week", range(7), "day_of_week")


def temporal_profile(logs: DataFrame, by: list[str] = UD) -> DataFrame:
    """Both histograms in one pass."""
    return logs.groupBy(*by).agg(
        *[how_many(F.col("hour") == v).alias(f"hour_{v}") for v in range(24)], *[how_many(F.col("day_of_week") == v).alias(f"day_of_week_{v}") for v in range(7)]
    )


def trailing(days: int, user: str = "user", date: str = "date"):
    """The user's rows of the last so many days, today's included."""
    return Window.partitionBy(user).orderBy(F.unix_date(date)).rangeBetween(-(days - 1), 0)


def rolling(daily: DataFrame, columns: list[str], days: int, how: str = "sum", suffix: str | None = None) -> DataFrame:
    """True trailing windows of daily columns, as <column>_<n>d."""
    w = trailing(days)
    return daily.withColumns({f"{c}_{suffix or f'{days}d'}": getattr(F, how)(c).over(w) for c in columns})


def rolling_distinct(logs: DataFrame, entity: str, days: int) -> DataFrame:
    """For each day a user was seen, how many different entities the last days held.

    An entity counts from a day it was seen to the last day that this reaches, or to the day before it was seen next: such
    stretches do not overlap. So each sighting adds one on its day and takes one away behind its stretch, and the running
    sum of a user's changes is the number, whatever the length of the window.
    """
    upcoming = F.lead("date").over(Window.partitionBy("user", entity).orderBy("date"))
    seen = logs.select("user", "date", entity).distinct().withColumn("upcoming", upcoming)
    known = F.col(entity).isNotNull().cast("int")
    over = F.least("upcoming", F.date_add("date", days))
    change = F.array(F.struct("date", known.alias("change"), F.lit(True).alias("is_day")), F.struct(over.alias("date"), (-known).alias("change"), F.lit(False).alias("is_day")))
    changes = seen.select("user", F.explode(change).alias("x")).groupBy("user", "x.date").agg(F.sum("x.change").alias("change"), F.max("x.is_day").alias("is_day"))
    running = F.sum("change").over(Window.partitionBy("user").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return changes.withColumn(f"unique_{entity}s_{days}d", running).where("is_day").select("user", "date", f"unique_{entity}s_{days}d")


def volume_drift(daily: DataFrame, column: str, days: int = 30) -> DataFrame:
    """The trailing mean, and the change against it: (n - mean) / (mean + 1)."""
    mean = F.avg(column).over(trailing(days))
    return daily.withColumn("baseline", mean).withColumn("volume_change", (F.col(column) - F.col("baseline")) / (F.col("baseline") + 1))


def baseline_drift(daily: DataFrame, column: str, pcs: str, contacts: str) -> DataFrame:
    """Against each user's mean day: a ratio up to 10 (1 without one), and a score with new machines and contacts."""
    mean = F.avg(column).over(Window.partitionBy("user"))
    ratio = F.when(mean > 0, F.least(F.col(column) / mean, F.lit(10.0))).otherwise(1.0)
    score = 0.5 * F.col("volume_change_ratio") + 0.25 * F.least(F.col(pcs), F.lit(5)) + 0.25 * F.least(F.col(contacts), F.lit(5))
    return daily.withColumn("volume_change_ratio", ratio).withColumn("drift_score", score)


def volume_proxy(daily: DataFrame, column: str) -> DataFrame:
    return daily.withColumn("volume_change_ratio", text.clipped(F.col(column) / 100, 0.0, 10.0))


def new_entities(logs: DataFrame, entity: str) -> DataFrame:
    """Entities that a user met for the first time, by day."""
    first = logs.where(F.col(entity).isNotNull()).groupBy("user", entity).agg(F.min("date").alias("date"))
    return first.groupBy(*UD).agg(F.count(F.lit(1)).alias(f"new_{entity}s"))


def behavioural_drift(daily: DataFrame, columns: list[str], globally: bool = False) -> DataFrame:
    """Mean over columns of std / (mean + 1), for each user, or one for all."""
    each = [F.coalesce(F.stddev_samp(c), F.lit(0.0)) / (F.avg(c) + 1) for c in columns]
    score = (sum(each[1:], each[0]) / len(each)).alias("behavioral_drift_score")
    return daily.agg(score) if globally else daily.groupBy("user").agg(score)


def degree_proxies(logs: DataFrame, by: list[str] = UD) -> DataFrame:
    """Events as degree, its clipped share as rank, and machines."""
    out = logs.groupBy(*by).agg(F.count("id").alias("degree"), F.countDistinct("pc").alias("pc_degree"))
    return out.withColumn("pagerank_proxy", text.clipped(F.col("degree") / 100, 0.0, 1.0))


def event_gaps(logs: DataFrame, key: str = "user") -> DataFrame:
    """Mean, std and median of the seconds between a key's events."""
    w = Window.partitionBy(key).orderBy("timestamp", "id")
    gaps = logs.withColumn("gap", timeops.seconds_between(F.lag("timestamp").over(w), F.col("timestamp")))
    g = F.col("gap")
    return gaps.groupBy(key).agg(F.avg(g).alias("gap_mean"), F.stddev_pop(g).alias("gap_std"), F.median(g).alias("gap_median"))


def user_means(features: DataFrame, columns: list[str]) -> DataFrame:
    return features.groupBy("user").agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def sequence_metadata(logs: dict[str, DataFrame], limit: int = 512) -> DataFrame:
    """For each user and day the events of all logs, and the length that a sequence takes."""
    out = None
    for df in logs.values():
        own = df.select(*UD)
        out = own if out is None else out.unionByName(own)
    return out.groupBy(*UD).agg(F.count(F.lit(1)).alias("event_count")).withColumns({"seq_len": F.least("event_count", F.lit(limit)), "session_count": F.lit(1), "label": F.lit(0)})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
