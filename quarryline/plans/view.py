"""From a chart's description to its dataset."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.charts import (
    AGGREGATE_OF,
    DERIVATIONS,
    ShelfField,
    category,
    scatter_points,
    series,
    share_of_total,
    shelf_query,
)
from ..operators.profile import is_dated
from ..sources.csv import export_snapshot

# The marks a shelf layout may ask for, and the charts that run along a date.
MARKS = ("Automatic", "Bar", "Line", "Area", "Circle", "Square", "Pie", "Text", "Shape", "GanttBar", "Multipolygon")
DATED_CHARTS = ("bar", "hbar", "line", "area")
DATED_MARKS = {"Bar": "bar", "Line": "line", "Area": "area"}


@dataclass(frozen=True)
class Shelves:
    """Fields placed on rows, columns and mark encodings."""

    mark: str = "Automatic"
    rows: tuple[ShelfField, ...] = ()
    cols: tuple[ShelfField, ...] = ()
    encodings: tuple[ShelfField, ...] = ()

    @property
    def fields(self) -> list[ShelfField]:
        return [*self.cols, *self.rows, *self.encodings]


@dataclass(frozen=True)
class ChartSpec:
    """A chart of one table."""

    table: str
    chart_type: str = "table"
    dimension: str | None = None
    measure: str | None = None
    measure2: str | None = None
    aggregation: str | None = None
    color_field: str | None = None
    geo_field: str | None = None
    date_granularity: str | None = None
    title: str | None = None
    shelves: Shelves | None = field(default=None)


def settle(spec: ChartSpec) -> ChartSpec:
    """Maps are drawn as bars of the place and donuts as pies."""
    if spec.chart_type == "map":
        return replace(spec, chart_type="bar", dimension=spec.dimension or spec.geo_field, geo_field=None)
    if spec.chart_type == "donut":
        return replace(spec, chart_type="pie")
    return spec


def check(df: DataFrame, spec: ChartSpec) -> None:
    """Refuses columns the table lacks (case is ignored) and shelf words nobody knows."""
    known = {name.lower() for name in df.columns}
    shelf_fields = spec.shelves.fields if spec.shelves else []
    named = [spec.dimension, spec.measure, spec.measure2, spec.geo_field, spec.color_field]
    for name in [*named, *[f.field for f in shelf_fields]]:
        if name and name.lower() not in known:
            raise ValueError(f"unknown column {name!r} on {spec.table}")
    problems = [f"derivation {f.derivation!r}" for f in shelf_fields if f.derivation not in DERIVATIONS]
    if spec.shelves and spec.shelves.mark not in MARKS:
        problems.insert(0, f"mark {spec.shelves.mark!r}")
    if problems:
        raise ValueError(f"unknown {', '.join(problems)}")


def date_dimension(df: DataFrame, spec: ChartSpec) -> str | None:
    """The date a chart runs along: its dimension, else the first dated field on a shelf."""
    dated = {f.name.lower() for f in df.schema.fields if is_dated(f)}
    shelf_fields = [f.field for f in spec.shelves.fields] if spec.shelves else []
    return next((name for name in [spec.dimension, *shelf_fields] if name and name.lower() in dated), None)


def _along(spec: ChartSpec) -> str | None:
    if spec.chart_type in DATED_CHARTS:
        return spec.chart_type
    return DATED_MARKS.get(spec.shelves.mark) if spec.shelves else None


def is_cumulative(df: DataFrame, spec: ChartSpec) -> bool:
    """Lines and areas of COUNT and SUM over time show growth to date."""
    dated = date_dimension(df, spec) is not None
    return dated and _along(spec) in ("line", "area") and (spec.aggregation or "COUNT").upper() in ("COUNT", "SUM")


def title_of(df: DataFrame, spec: ChartSpec) -> str | None:
    if spec.title and is_cumulative(df, spec) and not re.search("(?i)cumulative|running|total|to date", spec.title):
        return f"Cumulative {spec.title}"
    return spec.title


def value_name(spec: ChartSpec, date: str) -> str:
    """What a series' values are called: the counted table, else the measure; never the date's name."""
    counted = (spec.aggregation or "COUNT").upper() == "COUNT"
    words = re.sub(r"\b\w", lambda m: m.group().upper(), spec.table.replace("_", " "))
    name = words if counted else spec.measure
    return name if name and name != date else "value"


def view_query(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """The dataset of a chart, lazily. Dated charts become series; shelves come before chart types."""
    spec = settle(spec)
    check(df, spec)
    date = date_dimension(df, spec)
    if date and _along(spec):
        return series(
            df,
            date,
            spec.measure,
            spec.aggregation or "COUNT",
            spec.date_granularity or "day",
            cumulative=is_cumulative(df, spec),
            value=value_name(spec, date),
        )
    if spec.shelves:
        return shelf_query(df, spec.shelves.fields)
    # An aggregation that charts without a date do not know is drawn as a sum.
    wanted = (spec.aggregation or "SUM").upper()
    aggregation = wanted if wanted in AGGREGATE_OF.values() else "SUM"
    if spec.chart_type == "pie":
        return share_of_total(df, spec.dimension, spec.measure, aggregation)
    if spec.chart_type == "scatter":
        return scatter_points(df, spec.dimension, spec.measure, spec.measure2, aggregation, spec.color_field)
    return category(df, spec.dimension, spec.measure, aggregation, spec.color_field)


def snapshot_view(df: DataFrame, spec: ChartSpec, path: str, limit: int | None = None) -> None:
    """Writes a chart's dataset as CSV, series in the order of time; a series needs dated rows.

    ``limit=SNAPSHOT_ROWS`` keeps the first periods or rows only.
    """
    dataset = view_query(df, spec)
    date = date_dimension(df, settle(spec))
    if date and _along(settle(spec)):
        if df.filter(F.col(f"`{date}`").isNotNull()).isEmpty():
            raise ValueError(f"no dated rows in `{spec.table}` to chart {date!r} over time")
        dataset = dataset.orderBy(date)
    export_snapshot(dataset, path, limit=limit)
