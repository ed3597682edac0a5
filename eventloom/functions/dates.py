"""Business-day arithmetic and availability rules as closed-form column expressions (weekends, no holidays)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First hour (UTC) of a call that counts for the next day.
AFTER_HOURS = 13


def roll_forward(day: Column) -> Column:
    """Saturday and Sunday become Monday."""
    return F.date_add(day, F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0))


def add_business_days(day: Column, n: int) -> Column:
    """n business days later (earlier if n < 0); from a weekend the first step ends on the next (previous) business day."""
    if n >= 0:
        w = F.least(F.weekday(day), F.lit(4))
        base = F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
        return F.date_add(base, (n + 2 * F.floor((w + n) / 5)).cast("int"))
    base = F.date_add(day, F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0))
    w = F.when(F.weekday(day) > 4, 0).otherwise(F.weekday(day))
    return F.date_sub(base, (-n + 2 * F.floor((4 - w - n) / 5)).cast("int"))


def _weekdays_before(day: Column) -> Column:
    k = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return 5 * F.floor(k / 7) + F.least(F.pmod(k, F.lit(7)), F.lit(5))


def business_days_between(a: Column, b: Column) -> Column:
    """Weekdays in [a, b)."""
    return (_weekdays_before(b) - _weekdays_before(a)).cast("int")


def entry_date(ts: Column) -> Column:
    """The day on which an event can first be traded: the next one if it came after hours, never on a weekend."""
    return roll_forward(F.date_add(ts.cast("date"), F.when(F.hour(ts) >= AFTER_HOURS, 1).otherwise(0)))


def availability_date(call: Column, ingest: Column, cutoff: str, lag: int = 2) -> Column:
    """Two business days after the call before the cut-off; after it the later of call and ingest; null without a call."""
    return F.when(call < F.lit(cutoff).cast("date"), add_business_days(call, lag)).when(call.isNotNull(), F.greatest(call, ingest))
