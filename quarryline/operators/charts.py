"""The datasets behind charts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate, aggregate_alias, aggregation_name
from ..functions.periods import period

# What a field on a shelf can be made into.
AGGREGATE_OF = {"sum": "SUM", "avg": "AVG", "cnt": "COUNT", "cntd": "COUNTD"}
PERIOD_OF = {"tday": "day", "tmonth": "month", "tyear": "year"}
DERIVATIONS = ("none", "year", *PERIOD_OF, *AGGREGATE_OF)


def category(df: DataFrame, dimension: str, measure: str, aggregation: str = "SUM", color: str | None = None) -> DataFrame:
    """The measure per category, and per colour field where one is given. COUNT skips null measures."""
    keys = [dimension] + ([color] if color and color != dimension else [])
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        aggregate(aggregation, measure).alias(aggregate_alias(aggregation, measure))
    )


def series(
    df: DataFrame,
    date: str,
    measure: str | None = None,
    aggregation: str = "COUNT",
    granularity: str = "day",
    cumulative: bool = False,
    value: str = "value",
) -> DataFrame:
    """One row per period, undated rows left out. COUNT counts rows.

    ``cumulative`` adds up to date, for COUNT and SUM only. Its window has no partition and so runs
    in one task, over the grouped result: a row per day of the calendar at most.
    """
    name = aggregation_name(aggregation)
    moment = F.col(f"`{date}`")
    periods = (
        df.filter(moment.isNotNull())
        .groupBy(period(moment, granularity).alias(date))
        .agg(aggregate(name, measure, count_rows=True).alias(value))
    )
    if not cumulative:
        return periods
    if name not in ("COUNT", "SUM"):
        raise ValueError(f"{name} cannot be accumulated")
    to_date = W.orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    return periods.withColumn(value, F.sum(value).over(to_date))


def share_of_total(df: DataFrame, dimension: str, measure: str, aggregation: str = "SUM") -> DataFrame:
    """Each category's aggregate as a percentage of the whole table's, with its label.

    The total is the aggregate over all rows, which for AVG and COUNTD is not the sum of the parts.
    It enters the plan as a scalar subquery, so nothing is joined.
    """
    name, value = aggregation_name(aggregation), aggregate_alias(aggregation, measure)
    parts = category(df, dimension, measure, name)
    if name in ("SUM", "COUNT"):  # the parts add up: the same exchange serves both
        total = parts.agg(F.sum(value))
    else:
        total = df.agg(aggregate(name, measure))
    share = F.round(F.try_divide(F.col(value), total.scalar()) * 100, 1)  # null where the total is zero
    return parts.withColumn("share", share).withColumn("label", F.concat(share.cast("string"), F.lit("%")))


def scatter_points(
    df: DataFrame,
    dimension: str | None,
    measure: str,
    measure2: str | None = None,
    aggregation: str = "SUM",
    color: str | None = None,
) -> DataFrame:
    """Two aggregates per value of the dimension and colour; without either one point for the table."""
    second = measure2 or measure
    axes = [aggregate(aggregation, measure).alias("x"), aggregate(aggregation, second).alias("y")]
    keys = [F.col(f"`{name}`") for name in dict.fromkeys((dimension, color)) if name]
    return df.groupBy(*keys).agg(*axes)


@dataclass(frozen=True)
class ShelfField:
    """A field placed on a shelf and what is made of it."""

    field: str
    derivation: str = "none"

    @property
    def alias(self) -> str:
        return self.field if self.derivation == "none" else f"{self.derivation}_{self.field}"


def _key(placed: ShelfField) -> Column:
    column = F.col(f"`{placed.field}`")
    if placed.derivation == "year":
        return F.year(column).alias(placed.alias)
    if placed.derivation in PERIOD_OF:
        return period(column, PERIOD_OF[placed.derivation]).alias(placed.alias)
    return column.alias(placed.alias)


def shelf_query(df: DataFrame, fields: list[ShelfField]) -> DataFrame:
    """Any layout of fields: bare and dated ones are the groups, the others are aggregated per group."""
    unknown = [f"{f.derivation!r} of {f.field}" for f in fields if f.derivation not in DERIVATIONS]
    if unknown:
        raise ValueError(f"unknown derivation {', '.join(unknown)}")
    placed = list(dict.fromkeys(fields))
    keys = [_key(f) for f in placed if f.derivation not in AGGREGATE_OF]
    values = [aggregate(AGGREGATE_OF[f.derivation], f.field).alias(f.alias) for f in placed if f.derivation in AGGREGATE_OF]
    if not values:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*values)


def geo_pairs(df: DataFrame, geo: str, color: str | None = None) -> DataFrame:
    """The places of a map and the colour of each."""
    return df.select(geo, *([color] if color and color != geo else [])).distinct()


def crosstab(
    df: DataFrame, row: str, column: str, measure: str, aggregation: str = "SUM", values: list | None = None
) -> DataFrame:
    """A table of rows by columns with the aggregate in the cells.

    Every column value becomes a column, of which Spark allows ``spark.sql.pivotMaxValues`` (10,000); ``crosstab_sparse`` has no
    such limit. Naming the column values saves the job that looks for them; a value they do not name is an error, since its rows would
    be lost.
    """
    if values is not None:
        named = F.coalesce(F.col(column).isin(*values), F.lit(False)) | (F.col(column).isNull() if None in values else F.lit(False))
        df = df.where(F.when(named, True).otherwise(F.raise_error(F.format_string("crosstab: no column for %s", F.col(column).cast("string"))).cast("boolean")))
    return df.groupBy(row).pivot(column, values).agg(aggregate(aggregation, measure))


def column_numbers(df: DataFrame, column: str) -> DataFrame:
    """``column, column_no``: the distinct values, null among them, numbered from 0 in their order, null last.

    Values are spread by range and numbered inside their task; what meets in one task is a count per range.
    """
    order = F.col(column).asc_nulls_last()
    spread = df.select(F.col(f"`{column}`").alias(column)).distinct().repartitionByRange(order).withColumn("_range", F.spark_partition_id())
    inside = spread.withColumn("_i", F.row_number().over(W.partitionBy("_range").orderBy(order)))
    sizes = inside.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).drop("_n")
    return inside.join(before, "_range").select(column, (F.col("_before") + F.col("_i") - 1).alias("column_no"))


def crosstab_sparse(df: DataFrame, row: str, column: str, measure: str, aggregation: str = "SUM", width: int = 10_000) -> DataFrame:
    """The cells of a cross-tab of any number of columns: ``row, part, cells``.

    ``cells`` lists a row's cells as ``column_no, column, value`` in order of columns (see ``column_numbers``), leaving out those
    that no row of the table falls into. Part p of a row holds the columns from p times ``width`` on, ``width`` of them at most, so
    no list outgrows a task. Null is a row and a column like any other.
    """
    cells = df.groupBy(F.col(f"`{row}`").alias("_row"), F.col(f"`{column}`").alias("_column")).agg(aggregate(aggregation, measure).alias("_value"))
    numbers = column_numbers(cells.select(F.col("_column").alias("_name")), "_name")
    placed = cells.join(numbers, F.col("_column").eqNullSafe(F.col("_name")))
    cell = F.struct("column_no", F.col("_column").alias("column"), F.col("_value").alias("value"))
    part = F.expr(f"column_no div {int(width)}").alias("part")
    return placed.groupBy(F.col("_row").alias(row), part).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
