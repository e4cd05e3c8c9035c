"""Frequencies and the dates that a calendar expects."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Argentine holidays of 2024 and 2025.
AR_HOLIDAYS = [
    "2024-01-01", "2024-02-12", "2024-02-13", "2024-03-24", "2024-03-28", "2024-03-29", "2024-04-02", "2024-05-01",
    "2024-05-25", "2024-06-17", "2024-06-20", "2024-07-09", "2024-08-17", "2024-10-12", "2024-11-18", "2024-12-08",
    "2024-12-25",
    "2025-01-01", "2025-03-03", "2025-03-04", "2025-03-24", "2025-04-02", "2025-04-17", "2025-04-18", "2025-05-01",
    "2025-05-25", "2025-06-16", "2025-06-20", "2025-07-09", "2025-08-17", "2025-10-12", "2025-11-20", "2025-11-21",
    "2025-12-08", "2025-12-25",
]


def holidays(country: str | None) -> list[dt.date]:
    return [dt.date.fromisoformat(d) for d in AR_HOLIDAYS] if (country or "").upper() == "AR" else []


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def infer_frequency(dates: DataFrame, column: str = "day") -> str | None:
    """Frequency of distinct dates by their median gap; None under two dates.

    A distinct date list is calendar-sized, whatever the table's."""
    gaps = dates.select(column, F.datediff(column, F.lag(column).over(W.orderBy(column))).alias("gap"))
    row = gaps.agg(F.median("gap").alias("gap"), F.bool_or(is_weekend(F.col(column))).alias("weekend")).first()
    return frequency_of(row["gap"], bool(row["weekend"]))


def frequency_of(median_gap: float | None, weekends: bool) -> str | None:
    if median_gap is None:
        return None
    if median_gap <= 1.5:
        return "D" if weekends else "B"
    for limit, name in ((5, "B"), (10, "W"), (40, "M"), (100, "Q")):
        if median_gap <= limit:
            return name
    return "A"


def expected_dates(days: Column, frequency: str) -> Column:
    """Which days a calendar of this frequency has, as a condition on a day."""
    return {
        "B": ~is_weekend(days),
        "W": F.weekday(days) == 6,
        "M": F.dayofmonth(days) == 1,
        "Q": F.trunc(days, "QUARTER") == days,
        "A": F.trunc(days, "YEAR") == days,
    }.get(frequency, F.lit(True))


def calendar(bounds: DataFrame, first: str, last: str, frequency: str, country: str | None = None) -> DataFrame:
    """The expected days between two columns of a one-row frame."""
    days = bounds.where(F.col(first).isNotNull()).select(F.explode(F.sequence(F.col(first), F.col(last))).alias("day"))
    wanted = days.where(expected_dates(F.col("day"), frequency))
    closed = holidays(country) if frequency == "B" else []
    return wanted.where(~F.col("day").isin(closed)) if closed else wanted
