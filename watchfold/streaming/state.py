"""State by user on streams: sessions numbered in order of event time, and the latest alerts of each user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequences import GAP_MINUTES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "user string, day bigint, us bigint, id string, event_type string"
LAST = "user string, day bigint, us bigint, session int, place int"
NUMBERED = f"{EVENT}, session int, place int"
DAY_MS, DAY_US = 86_400_000, 86_400_000_000
#: Users are dealt to so many keys of state; a stream that goes on from its checkpoint has to keep the number.
BUCKETS = 1024
#: A bucket is looked at once in so much event time at most, and then as a whole.
EVERY_MS = 300_000


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def with_rocks(spark: SparkSession) -> None:
    """Keyed state with lists and timers needs this store; it takes effect in queries that start from now on."""
    spark.conf.set(PROVIDER, ROCKS)


class DaySessions(StatefulProcessor):
    """One bucket of users, whose days are numbered together. Events wait in a list until the watermark has passed them, and are then numbered in order.

    One timer is set at a time: for the earliest event that waits, or else for the end of the earliest day, behind which
    the watermark lets nothing of that day in any more and its last numbers go.
    """

    def __init__(self, gap_seconds: int, logoff_starts: bool):
        self.gap_seconds, self.opening = gap_seconds, ("logon", "logoff") if logoff_starts else ("logon",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.last = handle.getListState("last", LAST)

    def wait(self, due: int, now: int = -1) -> None:
        """A timer at due, unless an earlier one is to come; those up to now are through."""
        due = -(-due // EVERY_MS) * EVERY_MS
        for timer in list(self.handle.listTimers()):
            if now < timer <= due:
                return
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)

    def held(self, state, schema: str) -> pd.DataFrame:
        return pd.DataFrame([tuple(x) for x in state.get()] if state.exists() else [], columns=names(schema))

    def kept(self, state, rows: pd.DataFrame) -> None:
        state.clear()
        if len(rows):
            state.put(list(rows.astype(object).itertuples(index=False, name=None)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = None
        for batch in rows:
            self.waiting.appendList(list(batch[names(EVENT)].astype(object).itertuples(index=False, name=None)))
            first = -(-int(batch["us"].min()) // 1000)
            due = first if due is None else min(due, first)
        if due is not None:
            self.wait(due)
        return iter(())

    def numbered(self, done: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
        """done in order, with session and place, which go on from their day's last ones. Microseconds are exact as doubles for longer than dates go."""
        day = ["user", "day"]
        done = done.sort_values([*day, "us", "id"], kind="stable", ignore_index=True)
        done = done.merge(last.astype({"us": float}).rename(columns={"us": "before", "session": "sessions", "place": "places"}), "left", day)
        before = done.groupby(day, sort=False)["us"].shift().astype(float).fillna(done["before"].astype(float))
        # a gap of more than so many minutes opens a session, one of just as many does not
        opens = done["event_type"].map(lambda x: isinstance(x, str) and x.lower() in self.opening).astype(bool) | ((done["us"] - before) // 1_000_000 > self.gap_seconds)
        keys = [done[x] for x in day]
        session = opens.astype(int).groupby(keys, sort=False).cumsum() + done["sessions"].astype(float).fillna(0)
        place = done.groupby(day, sort=False).cumcount() + 1 + done["places"].astype(float).fillna(0)
        return done[names(EVENT)].assign(session=session.astype("int32"), place=place.astype("int32"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting, last = self.held(self.waiting, EVENT), self.held(self.last, LAST)
        passed = waiting["us"].astype("int64") <= now * 1000
        done, rest = waiting[passed], waiting[~passed]
        out = self.numbered(done.astype({"us": "int64"}), last) if len(done) else None
        if out is not None:
            self.kept(self.waiting, rest)
            last = pd.concat([last, out[names(LAST)]]).drop_duplicates(["user", "day"], keep="last")
        last = last[(last["day"].astype("int64") + 1) * DAY_MS > now]
        self.kept(self.last, last)
        if len(rest):
            self.wait(-(-int(rest["us"].min()) // 1000), now)
        elif len(last):
            self.wait((int(last["day"].min()) + 1) * DAY_MS, now)
        if out is not None:
            yield out

    def close(self) -> None:
        pass


def day_sessions(events: DataFrame, gap_minutes: int = GAP_MINUTES, logoff_starts: bool = False, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """A stream's events (id, user, timestamp, event_type) with session and place, as sequences.sessions numbers them, once the watermark has passed them.

    Events may be late by as much as the watermark allows; later ones are dropped. Events without a user or time are left out.
    State is kept by bucket of users, not by user and day: calls of Python are as many as buckets, not as user-days.
    """
    with_rocks(events.sparkSession)
    at = F.col("timestamp").cast("timestamp")
    rows = events.where("user IS NOT NULL AND timestamp IS NOT NULL").select(at.alias("timestamp"), "user", F.col("id").cast("string").alias("id"), "event_type").withWatermark("timestamp", late)
    us = F.unix_micros("timestamp")
    keyed = rows.select("timestamp", "user", "id", "event_type", us.alias("us"), F.floor(us / DAY_US).cast("long").alias("day"), F.pmod(F.xxhash64("user"), F.lit(buckets)).alias("bucket"))
    found = keyed.groupBy("bucket").transformWithStateInPandas(DaySessions(gap_minutes * 60, logoff_starts), NUMBERED, "Append", "EventTime")
    return found.select("id", "user", F.timestamp_micros("us").alias("timestamp"), F.to_date(F.timestamp_micros("us")).alias("date"), "event_type", "session", "place")


class LatestAlerts(StatefulProcessor):
    """The k latest alerts of one user, in a list; each batch gives the list as it then is."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getListState("latest", "ms bigint, id string, message string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(x) for x in self.latest.get()] if self.latest.exists() else []
        for batch in rows:
            held += [tuple(r) for r in batch[["ms", "id", "message"]].astype(object).itertuples(index=False)]
        held = sorted(set(held), key=lambda x: (-x[0], x[1]))[: self.k]
        self.latest.put(held)
        yield pd.DataFrame([(*key, n + 1, *x) for n, x in enumerate(held)], columns=["user", "place", "ms", "id", "message"])

    def close(self) -> None:
        pass


def latest_alerts(alerts: DataFrame, k: int = 50) -> DataFrame:
    """user, place (1 is the latest), timestamp, id and message: after each batch the k latest alerts (id, user, timestamp, message) of the users it has."""
    with_rocks(alerts.sparkSession)
    rows = alerts.where("user IS NOT NULL AND timestamp IS NOT NULL").select("user", F.unix_millis(F.col("timestamp").cast("timestamp")).alias("ms"), F.col("id").cast("string").alias("id"), "message")
    found = rows.groupBy("user").transformWithStateInPandas(LatestAlerts(k), "user string, place int, ms bigint, id string, message string", "Update", "None")
    return found.select("user", "place", F.timestamp_millis("ms").alias("timestamp"), "id", "message")
