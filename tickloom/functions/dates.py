"""Date bounds, calendars and timestamp parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Calendar days per relative period.
PERIOD_DAYS = {"1d": 1, "5d": 5, "1mo": 30, "3mo": 91, "6mo": 182, "1y": 365, "2y": 730, "5y": 1825, "10y": 3650}
WARMUP_DAYS = 400


def period_start(period: str, as_of: Column) -> Column:
    """First date of a relative period ending at ``as_of``; null means no lower bound."""
    if period == "ytd":
        return F.trunc(as_of, "year")
    if period == "max":
        return F.lit("0001-01-01").cast("date")
    return F.date_sub(as_of, PERIOD_DAYS[period])


def weekday_calendar(spark: SparkSession, first: str, last: str, holidays: DataFrame | None = None) -> DataFrame:
    """Business days between two dates; ``holidays(date)`` are left out."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}')")).alias("date"))
    days = days.where(F.dayofweek("date").between(2, 6))
    return days if holidays is None else days.join(holidays, "date", "left_anti")


def market_open(ts: Column) -> Column:
    """Regular New York session, Monday to Friday 09:30 to 16:00, for a UTC time."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    return F.dayofweek(local).between(2, 6) & (minute >= 570) & (minute < 960)
