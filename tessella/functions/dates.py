"""Dates in questions, as inclusive bounds; moments in a time zone."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Shanghai"

# Fixed words: periods relative to today, and what stands before and after a number of days.
THIS_YEAR = ("今年", "本年", "this year")
THIS_MONTH = ("本月", "这个月", "this month")
LAST_QUARTER = ("上季度", "last quarter", "previous quarter")
DAYS_BEFORE, DAYS_AFTER = ("最近", "近", "last"), ("天", "day")
FIRST_YEAR, LAST_YEAR = 1900, 2099


def month_span(months: int) -> tuple[date, date]:
    """First and last day of a month, numbered from year 0."""
    year, month = divmod(months, 12)
    return date(year, month + 1, 1), date(year, month + 1, monthrange(year, month + 1)[1])


def _months(today: date, first: int, last: int) -> tuple[date, date]:
    """From the first day of one month to the last of another, both counted from the month of ``today``."""
    here = today.year * 12 + today.month - 1
    return month_span(here + first)[0], month_span(here + last)[1]


#: Words of a period -> its months, counted from that of today.
PERIODS = (
    (THIS_YEAR, lambda today: _months(today, 1 - today.month, 12 - today.month)),
    (THIS_MONTH, lambda today: _months(today, 0, 0)),
    (LAST_QUARTER, lambda today: _months(today, -3 - (today.month - 1) % 3, -1 - (today.month - 1) % 3)),
)


def numbers(question: str) -> list[tuple[int, str, str, int]]:
    """(value, lower-case text before, text after, digits) of every run of digits, white space next to it aside."""
    low = question.lower()
    return [(int(m.group()), low[: m.start()].rstrip(), low[m.end() :].lstrip(), len(m.group())) for m in re.finditer("[0-9]+", low)]


def period(question: str, today: date) -> tuple[date, date] | None:
    """First and last day of the period a question names relative to ``today``."""
    low = question.lower()
    named = {words: span(today) for words, span in PERIODS if any(w in low for w in words)}
    days = next((n for n, before, after, size in numbers(question) if n and size <= 3 and before.endswith(DAYS_BEFORE) and after.startswith(DAYS_AFTER)), None)
    for words, _ in PERIODS[:2]:
        if words in named:
            return named[words]
    return (today - timedelta(days=days - 1), today) if days else named.get(LAST_QUARTER)


def explicit_year(question: str) -> int | None:
    return next((n for n, _, _, size in numbers(question) if size == 4 and FIRST_YEAR <= n <= LAST_YEAR), None)


def bounds(first: date, last: date, time_format: str | None) -> tuple[str, str]:
    """Text bounds in a dimension's format."""
    if time_format == "yyyymm":
        return first.strftime("%Y%m"), last.strftime("%Y%m")
    return first.isoformat(), end_of_day(last.isoformat(), time_format)


def end_of_day(bound: str, time_format: str | None) -> str:
    if time_format == "iso_datetime" and re.fullmatch(r"\d{4}-\d{2}-\d{2}", bound):
        return f"{bound}T23:59:59"
    return bound


def to_utc_text(moment: Column, zone: str = LOCAL_ZONE) -> Column:
    """A moment without a zone, read in ``zone``, as ISO text in UTC."""
    return F.concat(F.date_format(F.convert_timezone(F.lit(zone), F.lit("UTC"), moment.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def to_local_text(moment: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), moment.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def from_epoch(seconds: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("UTC"), F.timestamp_seconds(seconds).cast("timestamp_ntz"))


def from_epoch_millis(millis: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("UTC"), F.timestamp_millis(millis).cast("timestamp_ntz"))


def moment_of(text: Column) -> Column:
    """A moment without a zone from ISO text or from seconds or milliseconds since 1970, else null."""
    digits = F.when(text.rlike(r"^[0-9]{1,13}$"), text).cast("bigint")
    whole = F.when(F.length(text) > 11, from_epoch_millis(digits)).otherwise(from_epoch(digits))
    return F.coalesce(whole, F.try_to_timestamp(F.regexp_replace(text, "[Zz]$", "")).cast("timestamp_ntz"))


def day_start(moment: Column) -> Column:
    return F.date_trunc("day", moment)


def day_end(moment: Column) -> Column:
    """The last second of a moment's day."""
    return F.date_trunc("day", moment) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def month_bucket(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")
