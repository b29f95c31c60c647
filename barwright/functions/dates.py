"""Business days, expiries and session dates as column expressions. Nothing reads the clock: `now` is an argument."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _days(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-05").cast("date"))  # a Monday


def weekdays_before(d: Column) -> Column:
    """Weekdays from Monday 1970-01-05 up to, not including, d."""
    n = _days(d)
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def weekdays_between(begin: Column, end: Column) -> Column:
    """Weekdays in [begin, end), without regard to holidays."""
    return weekdays_before(end) - weekdays_before(begin)


def calendar(spark: SparkSession, first: str, last: str, holidays: Sequence[str] = ()) -> DataFrame:
    """date, n: the business days from first to last, both included, numbered from 1."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    open_days = days.where(F.weekday("date") < 5)
    if holidays:
        open_days = open_days.where(~F.col("date").isin([F.lit(h).cast("date") for h in holidays]))
    return open_days.select("date", F.row_number().over(Window.orderBy("date")).alias("n"))


def business_days(begin: Column, end: Column, holidays: Sequence[str] = ()) -> Column:
    """Business days in [begin, end): weekdays less the holidays among them. Negative if end is before begin."""
    n = weekdays_between(begin, end)
    for h in holidays:
        day = F.lit(h).cast("date")
        on_weekday = F.weekday(day) < 5
        n = n - F.when(on_weekday & (day >= begin) & (day < end), 1).when(on_weekday & (day < begin) & (day >= end), -1).otherwise(0)
    return n


def third_friday(d: Column) -> Column:
    """The third Friday of d's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(d, "month"), 1), "FRI"), 14)


def next_friday(d: Column) -> Column:
    """The Friday of d's week, Monday to Sunday: for a weekend the Friday before it."""
    return F.date_add(d, 4 - F.weekday(d))


def next_monthly_expiry(d: Column) -> Column:
    """The first third Friday on or after d."""
    own = third_friday(d)
    return F.when(own >= d, own).otherwise(third_friday(F.add_months(F.trunc(d, "month"), 1)))


def january_expiry(d: Column) -> Column:
    """The third Friday of the January after d's year begins (d itself included)."""
    own = third_friday(F.make_date(F.year(d), F.lit(1), F.lit(1)))
    return F.when(own >= d, own).otherwise(third_friday(F.make_date(F.year(d) + 1, F.lit(1), F.lit(1))))


def filing_quarter(d: Column) -> Column:
    return F.concat(F.lit("QTR"), F.quarter(d))


def session_date(now: Column, cutoff_hour: int, zone: str = "America/New_York") -> Column:
    """The latest session whose data exist at `now` (UTC): today from the cutoff hour (zone time) on, else the day before; weekends go back to Friday."""
    local = F.from_utc_timestamp(now, zone)
    day = F.when(F.hour(local) >= cutoff_hour, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
