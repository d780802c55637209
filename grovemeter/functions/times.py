"""Time text, calendar arithmetic and epoch conversions.

A time argument is a year (``2018``), a month (``2018-06``, ``June 2018``), a date
(``20180623``, ``23 June 2018`` or any ISO form) or a span before the reference time
(``1y6m``, ``10 days``, ``1.5h``). Spans are calendar spans: years, months, weeks, days, hours,
minutes and seconds in that order, months clamp at the end of the month, a bare ``m`` means
months, and weeks and what is shorter may have fractions.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The span grammar, largest unit first.
SPAN_PATTERN = (
    r"^(?:(\d+) ?y(?:rs?|ears?)?)?"
    r" ?(?:(\d+) ?(?:mo(?:nths?)?|m(?!in|o)))?"
    r" ?(?:(\d+(?:\.\d+)?) ?w(?:eeks?)?)?"
    r" ?(?:(\d+(?:\.\d+)?) ?d(?:ays?)?)?"
    r" ?(?:(\d+(?:\.\d+)?) ?h(?:ours?)?)?"
    r" ?(?:(\d+(?:\.\d+)?) ?min(?:utes?)?)?"
    r" ?(?:(\d+(?:\.\d+)?) ?s(?:ec(?:onds?)?)?)?$"
)
UNIT_SECONDS = (604800, 86400, 3600, 60, 1)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH_PATTERN = (
    r"^(?:(\d{1,2}) )?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    r"(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)? (\d{4})$"
)
YEAR_PATTERN = r"^\d{4}$"
YEAR_MONTH_PATTERN = r"^\d{4}-\d{2}$"
DAY_PATTERN = r"^\d{8}$"


def months_before(moment: datetime, months: int) -> datetime:
    """``moment`` less whole calendar months, clamped to the end of the month."""
    index = moment.year * 12 + moment.month - 1 - months
    year, month = divmod(index, 12)
    following = datetime(year + (month == 11), (month + 1) % 12 + 1, 1)
    last_day = (following - timedelta(days=1)).day
    return moment.replace(year=year, month=month + 1, day=min(moment.day, last_day))


def parse_time(text: str, as_of: datetime | None = None) -> float:
    """Epoch seconds (UTC) of a time argument without its sign."""
    text = text.strip().lower()
    month = re.match(MONTH_PATTERN, text)
    if re.match(YEAR_PATTERN, text):
        moment = datetime(int(text), 1, 1)
    elif re.match(DAY_PATTERN, text):
        moment = datetime.strptime(text, "%Y%m%d")
    elif re.match(YEAR_MONTH_PATTERN, text):
        moment = datetime.strptime(text, "%Y-%m")
    elif month:
        moment = datetime(int(month[3]), MONTHS.index(month[2]) + 1, int(month[1] or 1))
    else:
        span = re.match(SPAN_PATTERN, text)
        if span and text:
            years, months = (int(g or 0) for g in span.groups()[:2])
            shorter = (Decimal(g or 0) for g in span.groups()[2:])
            start = as_of or datetime.now(timezone.utc)
            moment = months_before(start, 12 * years + months) - timedelta(
                microseconds=int(1_000_000 * sum(n * unit for n, unit in zip(shorter, UNIT_SECONDS)))
            )
        else:
            moment = datetime.fromisoformat(text)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return moment.timestamp()


def time_epoch(text: Column, as_of: Column) -> Column:
    """Column form of :func:`parse_time`; ``as_of`` is a timestamp column.

    Runs in the session time zone, which the entry point pins to UTC.
    """
    text = F.lower(F.trim(text))

    def number(pattern: str, group: int, kind: str, missing: int = 0) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast(kind), F.lit(missing).cast(kind))

    shorter = [number(SPAN_PATTERN, 3 + i, "decimal(18,6)") * unit for i, unit in enumerate(UNIT_SECONDS)]
    seconds = reduce(lambda a, b: a + b, shorter).cast("decimal(18,6)")
    span_start = (
        as_of
        - F.make_ym_interval(number(SPAN_PATTERN, 1, "int"), number(SPAN_PATTERN, 2, "int"))
        - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    )
    name = F.regexp_extract(text, MONTH_PATTERN, 2)
    by_name = F.make_timestamp(
        number(MONTH_PATTERN, 3, "int"), F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int"),
        number(MONTH_PATTERN, 1, "int", 1), F.lit(0), F.lit(0), F.lit(0),
    )
    moment = (
        F.when(text.rlike(YEAR_PATTERN), F.to_timestamp(text, "yyyy"))
        .when(text.rlike(DAY_PATTERN), F.to_timestamp(text, "yyyyMMdd"))
        .when(text.rlike(MONTH_PATTERN), by_name)
        .when(text.rlike(SPAN_PATTERN) & (text != ""), span_start)
        .otherwise(F.upper(text).cast("timestamp"))
    )
    return F.unix_micros(moment) / F.lit(1e6)


def signed_time_epoch(text: Column, as_of: Column) -> Column:
    """As :func:`time_epoch`, with a leading ``-`` giving the negative ("older than") form.

    A leading ``+`` changes nothing.
    """
    older = text.startswith("-")
    signed = older | text.startswith("+")
    epoch = time_epoch(F.when(signed, F.substr(text, F.lit(2))).otherwise(text), as_of)
    return F.when(older, -epoch).otherwise(epoch)


def epoch_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def before(moment: Column, months: int, days: int) -> Column:
    """``moment`` less whole calendar months, then whole days."""
    return (
        moment
        - F.make_ym_interval(F.lit(0), F.lit(months))
        - F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(0))
    )
