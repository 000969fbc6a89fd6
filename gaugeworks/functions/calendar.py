"""Calendar parts, cyclic encodings and time helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import col

DAY_SECONDS = 86400
WEEKDAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp (with or without zone; the session is UTC)."""
    return F.unix_seconds(col(ts).cast("timestamp"))


def epoch_micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def is_weekend(ts: Column | str) -> Column:
    return F.dayofweek(col(ts)).isin(1, 7)


def iso_weekday(ts: Column | str) -> Column:
    """Monday = 0."""
    return F.weekday(col(ts))


def weekday_name(ts: Column | str) -> Column:
    return F.date_format(col(ts), "E")


def month_key(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def days_in_month(day: Column | str) -> Column:
    return F.dayofmonth(F.last_day(col(day)))


def remaining_month_days(day: Column | str, limit: int = 7) -> Column:
    """Longest window starting on the day that stays within its month."""
    return F.least(F.lit(limit), days_in_month(day) - F.dayofmonth(col(day)) + 1)


def parse_timestamp(c: str) -> Column:
    """Timestamp value; text that cannot be read becomes NULL instead of an error."""
    return F.try_to_timestamp(F.col(c).cast("string"))


def standardize_time(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Parse the time column and add calendar parts; any unreadable or missing time fails the job.

    The check runs inside the scan (``raise_error``), so no separate pass over the data is needed.
    """
    parsed = parse_timestamp(time)
    checked = F.when(parsed.isNull(), F.raise_error(F.lit(f"{time} has missing or unreadable values"))).otherwise(parsed)
    ts = F.col(time)
    return df.withColumn(time, checked.cast("timestamp")).withColumns({
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts),
        "day_of_week": F.dayofweek(ts), "is_weekend": is_weekend(ts),
    })


def add_calendar_features(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Calendar parts plus sine/cosine encodings of the hour and weekday."""
    ts = F.col(time)
    hour, weekday = F.hour(ts), F.dayofweek(ts)
    turn = 2 * math.pi
    return df.withColumns({
        "hour": hour, "weekday": weekday, "year": F.year(ts), "month": F.month(ts),
        "day_of_month": F.dayofmonth(ts), "week_of_year": F.weekofyear(ts), "is_weekend": is_weekend(ts),
        "hour_sin": F.sin(turn * hour / 24), "hour_cos": F.cos(turn * hour / 24),
        "weekday_sin": F.sin(turn * (weekday - 1) / 7), "weekday_cos": F.cos(turn * (weekday - 1) / 7),
    })


def time_range(ts: Column | str, *ranges: tuple[str, str]) -> Column:
    """Half-open ranges joined with OR; the raw column is compared, so Parquet can skip row groups.

    The bounds stay text literals: Spark turns them into the column's own timestamp type, with or without zone.
    """
    t = col(ts)
    out = F.lit(False)
    for start, end in ranges:
        part = (t >= F.lit(start)) & (t < F.lit(end))
        out = part if len(ranges) == 1 else (out | part)
    return out


def in_month(ts: Column | str, month: int | None) -> Column:
    return F.lit(True) if month is None else F.month(col(ts)) == month
