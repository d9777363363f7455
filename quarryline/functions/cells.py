"""Rows of cells held as arrays, the shape that JSON tables and scanned pages arrive in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_cells(cells: Column, width: Column) -> Column:
    """Cells cut, or filled up with empty text, to exactly ``width``; null cells become empty."""
    present = F.transform(cells, lambda cell: F.coalesce(cell, F.lit("")))
    missing = F.greatest(width - F.size(present), F.lit(0))
    return F.slice(F.concat(present, F.array_repeat(F.lit(""), missing)), F.lit(1), width)


def to_rectangular(df: DataFrame, names: list[str], cells: str = "cells", keep: tuple[str, ...] = ()) -> DataFrame:
    """One named text column per cell position, next to the columns in ``keep``."""
    fitted = df.withColumn(cells, fit_cells(F.col(cells), F.lit(len(names))))
    return fitted.select(*keep, *[F.col(cells)[i].alias(name) for i, name in enumerate(names)])
