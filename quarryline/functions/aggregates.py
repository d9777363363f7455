"""The six aggregations a table or chart can ask for, and the names of their columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATIONS = ("COUNT", "COUNTD", "SUM", "AVG", "MIN", "MAX")


def aggregation_name(aggregation: str) -> str:
    name = aggregation.upper()
    if name not in AGGREGATIONS:
        raise ValueError(f"unsupported aggregation {aggregation!r}: one of {', '.join(AGGREGATIONS)}")
    return name


def aggregate(aggregation: str, measure: str | None, count_rows: bool = False) -> Column:
    """The aggregate of a measure. COUNT counts rows when asked to, or when there is no measure."""
    name = aggregation_name(aggregation)
    if name == "COUNT" and (count_rows or not measure):
        return F.count("*")
    if not measure:
        raise ValueError(f"{name} needs a measure")
    value = F.col(f"`{measure}`")
    if name == "COUNTD":
        return F.count_distinct(value)
    return {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](value)


def aggregate_alias(aggregation: str, measure: str | None) -> str:
    """``sum_price``, ``countd_user_id``; ``count_rows`` without a measure."""
    return re.sub(r"[^A-Za-z0-9_]", "_", f"{aggregation.lower()}_{measure or 'rows'}")
