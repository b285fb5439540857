"""Time: parsing, calendar parts, working hours. Days count from 0 = Monday; `iso` counts from 1 = Monday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORK_START, WORK_END = 8, 18
WORK_DAYS = (0, 1, 2, 3, 4)
# Holidays that the working-hours rules must know.
HOLIDAYS = (
    "2010-01-01", "2010-01-18", "2010-02-15", "2010-05-31", "2010-07-04", "2010-09-06", "2010-10-11", "2010-11-11",
    "2010-11-25", "2010-12-24", "2010-12-25", "2010-12-31", "2011-01-01", "2011-01-17", "2011-02-21", "2011-05-30",
)


def parse_timestamp(text: Column) -> Column:
    """`M/d/yyyy H:mm:ss` or without seconds, with or without leading zeros; null if neither."""
    tried = [F.try_to_timestamp(text, F.lit(f)) for f in ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm")]
    return F.coalesce(*tried).cast("timestamp_ntz")


def parse_any(text: Column) -> Column:
    """US and ISO forms, with a blank or T; null if none fits."""
    formats = ("M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_month(text: Column) -> Column:
    return F.to_date(F.concat(text, F.lit("-01")))


def day_of_week(ts: Column, as_written: bool = False) -> Column:
    return F.weekday(ts) + (1 if as_written else 0)


def is_weekend(ts: Column, as_written: bool = False) -> Column:
    """Saturday and Sunday; as written, which counted from 1, Friday too."""
    return day_of_week(ts, as_written) >= 5


def is_holiday(ts: Column, holidays: tuple[str, ...] = HOLIDAYS) -> Column:
    return F.date_format(ts, "yyyy-MM-dd").isin(*holidays)


def is_working_hours(ts: Column, start: int = WORK_START, end: int = WORK_END, days: tuple[int, ...] = WORK_DAYS, holidays: tuple[str, ...] | None = None, as_written: bool = False) -> Column:
    """From start to before end on a working day; no for a null time. With holidays, not on these."""
    inside = (F.hour(ts) >= start) & (F.hour(ts) < end) & day_of_week(ts, as_written).isin(*days)
    if holidays is not None:
        inside = inside & ~is_holiday(ts, holidays)
    return F.coalesce(inside, F.lit(False))


def is_after_hours(ts: Column, **rules) -> Column:
    return ~is_working_hours(ts, **rules)


def is_late_night(ts: Column) -> Column:
    return (F.hour(ts) >= 22) | (F.hour(ts) < 5)


def is_off_hours(ts: Column) -> Column:
    return (F.hour(ts) >= WORK_END) | (F.hour(ts) < WORK_START)


def is_night(ts: Column) -> Column:
    return (F.hour(ts) >= 22) | (F.hour(ts) < 6)


def is_office_hour(ts: Column) -> Column:
    """Working hours whatever the day."""
    return (F.hour(ts) >= WORK_START) & (F.hour(ts) < WORK_END)


def hour_share(ts: Column) -> Column:
    return F.hour(ts) / F.lit(23.0)


def day_share(ts: Column) -> Column:
    return F.weekday(ts) / F.lit(6.0)


def time_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b."""
    return F.timestamp_diff("SECOND", a, b)


def calendar(df: DataFrame, ts: str = "timestamp", holiday_rule: bool = False, as_written: bool = False) -> DataFrame:
    """df with hour, day_of_week, week, month, year, date and the four flags; holiday_rule: also day and time_bucket, and no work on holidays."""
    t = F.col(ts)
    holidays = HOLIDAYS if holiday_rule else None
    working = is_working_hours(t, holidays=holidays, as_written=as_written)
    more = {"day_of_month": F.dayofmonth(t), "time_bucket": time_bucket(t)} if holiday_rule else {}
    return df.withColumns(
        {
            "hour": F.hour(t), "day_of_week": day_of_week(t, as_written), "week": F.weekofyear(t), "month": F.month(t), "year": F.year(t), "date": F.to_date(t),
            "is_weekend": is_weekend(t, as_written), "is_working_hours": working, "is_after_hours": ~working, "is_holiday": is_holiday(t),
        }
        | more
    )


def days_between(df: DataFrame, start: str, end: str, name: str = "date") -> DataFrame:
    """A row for each day of each row's closed interval."""
    return df.withColumn(name, F.explode(F.sequence(F.to_date(F.col(start)), F.to_date(F.col(end)), F.expr("interval 1 day"))))


def month_ends(df: DataFrame, start: str, end: str, name: str = "snapshot") -> DataFrame:
    """A row for each month's last day between two dates' months."""
    months = F.sequence(F.trunc(F.col(start), "month"), F.trunc(F.col(end), "month"), F.expr("interval 1 month"))
    return df.withColumn(name, F.explode(F.transform(months, F.last_day)))
