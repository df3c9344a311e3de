"""Date formats, day bounds and windows as Column expressions; the session's time zone holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats in use.
FORMATS = {"compact": "yyyyMMddHHmmss", "hour": "HHmm", "us_day": "MM/dd/yyyy", "time": "HH:mm:ss", "full": "yyyy/MM/dd HH:mm:ss", "file": "yyyyMMdd-HH-mm-ss"}


def formatted(ts: Column, name: str) -> Column:
    return F.date_format(ts, FORMATS[name])


def from_millis(ms: Column, name: str = "full") -> Column:
    return F.date_format(F.timestamp_millis(ms), FORMATS[name])


def now_in(zone: str) -> Column:
    return F.convert_timezone(None, F.lit(zone), F.localtimestamp())


def start_of_day(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def end_of_day(ts: Column) -> Column:
    """The day's last microsecond, the finest that the engine has."""
    return F.date_trunc("day", ts) + F.expr("interval 1 day") - F.expr("interval 1 microsecond")


def in_survey_window(ts: Column, first_day: int, last_day: int) -> Column:
    """Whether a day lies in the monthly window from first_day to last_day of the next month (if last_day < first_day) or the same."""
    day = F.dayofmonth(ts)
    return day.between(first_day, last_day) if first_day <= last_day else (day >= first_day) | (day <= last_day)


def older_than_minutes(seconds: Column, minutes: int = 1) -> Column:
    """Whole minutes of an age over a bound: 119 seconds are one minute, 120 are two."""
    return F.floor(seconds / 60) > minutes


def latency_ms(sent_ms: Column, now_ms: Column | None = None) -> Column:
    return (now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())) - sent_ms
