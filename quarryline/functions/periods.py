"""Cutting dates to periods.

Everything goes through the date type: unlike ``date_trunc`` on a zoned timestamp, that does not
depend on the session's time zone for values without one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("day", "month", "year")


def period(moment: Column, granularity: str = "day") -> Column:
    """Start of the day, month or year as a timestamp without zone; anything else means day."""
    wanted = (granularity or "").lower()
    day = moment.cast("date")
    start = F.trunc(day, wanted) if wanted in ("month", "year") else day
    return start.cast("timestamp_ntz")
