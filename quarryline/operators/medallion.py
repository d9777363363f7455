"""From raw rows to a clean table to a business aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import aggregate, aggregate_alias
from ..sources.csv import drop_empty_rows
from ..sources.tables import INGESTED_AT, business_columns
from .profile import EXACT_VALUES, STATE_ERROR, column_states, distinct_counts


def dedup_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one that comes last in ``order``; null keys are one group.

    Spark drops all but the first row per key in each task before the exchange (WindowGroupLimit).
    """
    latest = W.partitionBy(*keys).orderBy(*[F.col(f"`{c}`").desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")


def promote_silver(bronze: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Business columns without empty rows, one row per key, the latest load winning.

    Without a key the whole row is the key. Which copy wins is then of no account, and a distinct
    needs neither sort nor window.
    """
    columns = business_columns(bronze)
    rows = drop_empty_rows(bronze, columns)
    if not key:
        return rows.select(*columns).distinct()
    ties = [name for name in columns if name not in key]
    return dedup_latest(rows, key, [INGESTED_AT, *ties]).select(*columns)


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")]


def dimension_scores(df: DataFrame, approx: bool = False) -> DataFrame:
    """Every text column with its distinct values and whether it groups: more than one value, but repeats."""
    names = _text_columns(df)
    if not names:
        raise ValueError("the table has no text column")
    return distinct_counts(df.select(*[F.col(f"`{c}`") for c in names]), approx).withColumn(
        "groups", (F.col("distinct_values") > 1) & (F.col("distinct_values") < F.col("n_rows"))
    )


def choose_dimension(df: DataFrame, approx: bool = False) -> str:
    """The text column with the fewest values that still groups; else the first text column, else the first.

    Columns with few values are told by their states, which exchange a sketch per column and task. Only where none of them
    groups are the others counted: exactly, or with ``approx`` by their states too.
    """
    names = _text_columns(df)
    if not names:
        return business_columns(df)[0]
    states = column_states(df.select(*[F.col(f"`{c}`") for c in names])).collect()
    few = [s for s in states if s["about"] <= EXACT_VALUES and 1 < s["about"] < s["n_rows"]]
    many = [s["column"] for s in states if s["about"] > EXACT_VALUES]
    if few or not many:
        return min(few, key=lambda s: (s["about"], s["position"]))["column"] if few else names[0]
    if approx:
        few = [s for s in states if s["about"] > EXACT_VALUES and s["about"] < s["n_rows"] * (1 - STATE_ERROR)]
        return min(few, key=lambda s: (s["about"], s["position"]))["column"] if few else names[0]
    best = dimension_scores(df.select(*[F.col(f"`{c}`") for c in many])).filter("groups").orderBy("distinct_values", "position").first()
    return best["column"] if best else names[0]


def promote_gold(silver: DataFrame, dimension: str, measure: str | None = None, aggregation: str = "COUNT") -> DataFrame:
    """One aggregate per value of the dimension, null included."""
    return silver.groupBy(F.col(f"`{dimension}`")).agg(
        aggregate(aggregation, measure, count_rows=True).alias(aggregate_alias(aggregation, measure))
    )
