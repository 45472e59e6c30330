"""Day-grain date arithmetic. Differences are BIGINT days, ages in months are days / 30.4375."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.4375
SECONDS_PER_HOUR = 3600


def day_diff(later, earlier) -> Column:
    """Signed number of days from ``earlier`` to ``later``."""
    return F.datediff(later, earlier).cast("bigint")


def months_between_days(later, earlier) -> Column:
    return day_diff(later, earlier) / F.lit(DAYS_PER_MONTH)


def age(day, birth, unit: str = "days") -> Column:
    if unit == "days":
        return day_diff(day, birth)
    if unit == "months":
        return months_between_days(day, birth)
    raise ValueError(f"unit must be 'days' or 'months', not {unit!r}")


def per_hour(count, seconds) -> Column:
    """Events per hour of observation; NULL when nothing was observed."""
    return F.try_divide(count, F.try_divide(seconds, F.lit(float(SECONDS_PER_HOUR))))


def epoch_day(col) -> Column:
    return F.datediff(col, F.lit("1970-01-01").cast("date"))
