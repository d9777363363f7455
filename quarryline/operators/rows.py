"""Plain questions to a table: counts, top rows, previews, and copy-on-write changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_per_group(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per group, most frequent first."""
    return df.groupBy(*columns).agg(F.count("*").alias("count_rows")).orderBy(F.desc("count_rows"), *columns)


def top_k(df: DataFrame, measure: str, k: int = 5, ties: list[str] | None = None) -> DataFrame:
    """The k rows of highest measure; ``ties`` decides between equal ones."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *(ties or [])).limit(k)


def preview(df: DataFrame, n: int = 20, order: list[str] | None = None) -> DataFrame:
    """The first rows, for looking at; without an order whichever are nearest."""
    return (df.orderBy(*order) if order else df).limit(n)


def last_n_per_user(df: DataFrame, user: str, order: list[str], n: int = 3) -> DataFrame:
    """The latest n rows of every user.

    Spark keeps only n rows per user in each task before the exchange (WindowGroupLimit), so one
    user owning much of the table does not fill a task. It does so for n up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``.
    """
    latest = W.partitionBy(user).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_place", F.row_number().over(latest)).filter(F.col("_place") <= n).drop("_place")


def holds(predicate: str | Column) -> Column:
    """True or false as SQL's WHERE reads it: unknown does not hold."""
    return F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False))


def delete_rows(df: DataFrame, predicate: str | Column) -> DataFrame:
    """What is left after deleting the rows the predicate holds for."""
    return df.filter(~holds(predicate))


def update_rows(df: DataFrame, assignments: dict[str, str | Column], predicate: str | Column) -> DataFrame:
    """The rows with columns assigned where the predicate holds; every expression sees the old row."""
    unknown = set(assignments) - set(df.columns)
    if unknown:
        raise ValueError(f"no column {', '.join(sorted(unknown))}")
    held = holds(predicate)

    def assigned(name: str) -> Column:
        if name not in assignments:
            return F.col(f"`{name}`")
        new = assignments[name]
        new = F.expr(new) if isinstance(new, str) else new
        return F.when(held, new.cast(df.schema[name].dataType)).otherwise(F.col(f"`{name}`")).alias(name)

    return df.select(*[assigned(name) for name in df.columns])
