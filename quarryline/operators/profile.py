"""What a table's columns are like, and which are worth charting."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How few values make a distribution, and how many of them a listing shows.
FEW_VALUES = (2, 15)
SHOWN_VALUES = 12

PARALLEL_TABLES = 8

_STATE_BITS = 12
#: Distinct values up to which a column's state counts them exactly, and by how much an estimate beyond may be off (five
#: times its standard error).
EXACT_VALUES, STATE_ERROR = 1 << _STATE_BITS, 5 / (1 << _STATE_BITS // 2)

_NUMERIC = (T.IntegralType, T.FloatType, T.DoubleType, T.DecimalType)
_DATED = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, _NUMERIC)


def is_float(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.FloatType, T.DoubleType))


def is_dated(field: T.StructField) -> bool:
    return isinstance(field.dataType, _DATED)


def role_of(field: T.StructField) -> str:
    return "measure" if is_numeric(field) else "dimension"


def _on_side(row: DataFrame, structs: list[Column]) -> DataFrame:
    return row.select(F.inline(F.array(*structs)))


def _value_text(field: T.StructField) -> Column:
    """A value as text, equal texts for equal values only."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0).cast(field.dataType)  # there are two zeros
    elif isinstance(field.dataType, T.TimestampType):
        value = F.unix_micros(value)  # local times repeat when clocks go back
    elif isinstance(field.dataType, T.BinaryType):
        value = F.base64(value)
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        value = F.to_json(value)
    return value.cast("string").alias(field.name)


def _distinct_by_value(df: DataFrame) -> DataFrame:
    """Counts by grouping cells under their column's name: rows stay narrow however wide the table is."""
    listing = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(c) for c in df.columns])).alias("position", "column")
    )
    cells = df.select(*[_value_text(f) for f in df.schema.fields])
    values = (
        cells.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "value")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    counts = values.groupBy("column").agg(F.sum("n").alias("n_rows"), F.count("value").alias("distinct_values"))
    return listing.join(counts, "column", "left").select(
        "position", "column", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "distinct_values")]
    )


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Rows and distinct non-null values of every column, from one scan.

    Exact counts exchange every distinct value of every column, as a cell under its column's name; values that are lists,
    maps or structs are compared by their JSON. ``approx=True`` exchanges one sketch per column and task, where that is too
    much.
    """
    if not approx:
        return _distinct_by_value(df)
    row = df.agg(
        F.count("*").alias("n"),
        *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(df.columns)],
    )
    structs = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.col("n").alias("n_rows"),
            F.col(f"d{i}").alias("distinct_values"),
        )
        for i, c in enumerate(df.columns)
    ]
    return _on_side(row, structs)


def column_states(df: DataFrame) -> DataFrame:
    """``position, column, n_rows, n_present, about`` of every column, from one scan that exchanges a sketch of fixed size per
    column and task, whatever the values.

    ``about`` is the number of distinct values: exact up to ``EXACT_VALUES`` (the sketch holds the hashes of them all), beyond
    that an estimate, which is always over it.
    """
    facts = [F.count("*").alias("n")]
    for i, field in enumerate(df.schema.fields):
        value = F.col(f"`{field.name}`")
        plain = isinstance(field.dataType, (T.StringType, T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType))
        seen = F.when(value.isNotNull(), F.xxhash64(value if plain else _value_text(field)))
        sketch = F.theta_sketch_estimate(F.theta_sketch_agg(seen, _STATE_BITS))
        facts += [F.count(value).alias(f"p{i}"), F.coalesce(sketch, F.lit(0)).alias(f"d{i}")]
    structs = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.col("n").alias("n_rows"),
            F.col(f"p{i}").alias("n_present"),
            F.when(F.col(f"p{i}") > 0, F.col(f"d{i}")).otherwise(0).cast("bigint").alias("about"),
        )
        for i, c in enumerate(df.columns)
    ]
    return _on_side(df.agg(*facts), structs)


def _long(df: DataFrame, columns: list[str], value: str, type_name: str) -> DataFrame:
    """One row per column and cell, all cells cast to one type."""
    cells = df.select(*[F.col(f"`{c}`").cast(type_name).alias(c) for c in columns])
    return cells.unpivot([], [F.col(f"`{c}`") for c in columns], "column", value)


def daily_counts(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Rows per day of each date column; a listing can ask for the first ``limit`` days only."""
    days = _long(df, columns, "day", "date").filter(F.col("day").isNotNull())
    counts = days.groupBy("column", "day").agg(F.count("*").alias("count_rows"))
    if limit is not None:
        first = W.partitionBy("column").orderBy("day")
        counts = counts.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= limit)
    return counts.select("column", F.col("day").cast("timestamp_ntz").alias("day"), "count_rows")


def daily_verdict(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per date column: its days, the first and last of them, and whether the counts differ."""
    return (
        daily_counts(df, columns)
        .groupBy("column")
        .agg(
            F.count("*").alias("n_days"),
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            F.min_by("count_rows", "day").alias("first_count"),
            (F.max("count_rows") != F.min("count_rows")).alias("varies"),
        )
    )


def _value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every value of each column with its count and place, equal values under one text; null has a place too."""
    fields = {f.name: f for f in df.schema.fields}
    cells = df.select(
        *[
            (F.col(f"`{c}`") + F.lit(0).cast(fields[c].dataType) if is_float(fields[c]) else F.col(f"`{c}`")).alias(c)
            for c in columns
        ]
    )
    counts = _long(cells, columns, "value", "string").groupBy("column", "value").agg(F.count("*").alias("count_rows"))
    frequent = W.partitionBy("column").orderBy(F.desc("count_rows"), F.asc_nulls_first("value"))
    return counts.withColumn("place", F.row_number().over(frequent)).withColumn("value", F.coalesce("value", F.lit("null")))


def value_distribution(df: DataFrame, columns: list[str], top: int = SHOWN_VALUES) -> DataFrame:
    """The ``top`` most frequent values of each column, null among them, with their counts and places."""
    return _value_counts(df, columns).filter(F.col("place") <= top).select("column", "value", "count_rows", "place")


def distribution_verdict(df: DataFrame, columns: list[str], top: int = SHOWN_VALUES) -> DataFrame:
    """Per column: its ``top`` values in words and how many more there are; whether all counts differ, and by how much."""
    text = F.struct("place", F.concat_ws("=", "value", "count_rows").alias("text"))
    shown = F.sort_array(F.collect_list(F.when(F.col("place") <= top, text)))
    more = F.when(F.count("*") > top, F.format_string(" and %d more", F.count("*") - top)).otherwise("")
    return (
        _value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.concat(F.array_join(F.transform(shown, lambda s: s["text"]), ", "), more).alias("shown"),
            (F.max("count_rows") != F.min("count_rows")).alias("varies"),
            F.round(F.stddev_pop("count_rows") / F.avg("count_rows"), 4).alias("spread"),
        )
    )


def numeric_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lowest, highest and average value (two decimals) of numeric columns, all from one aggregate."""
    facts = []
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`")
        facts += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"), F.round(F.avg(value), 2).alias(f"av{i}")]
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"lo{i}").cast("double").alias("min_value"),
            F.col(f"hi{i}").cast("double").alias("max_value"),
            F.col(f"av{i}").cast("double").alias("avg_value"),
            F.concat_ws(
                ", ",
                F.concat(F.lit("min "), F.col(f"lo{i}").cast("string")),
                F.concat(F.lit("max "), F.col(f"hi{i}").cast("string")),
                F.concat(F.lit("avg "), F.col(f"av{i}").cast("string")),
            ).alias("shown"),
        )
        for i, c in enumerate(columns)
    ]
    return _on_side(df.agg(*facts), structs)


@dataclass(frozen=True)
class ColumnKind:
    """A column's place, distinct values and the probe that says most about it."""

    position: int
    name: str
    type_name: str
    role: str
    n_rows: int
    distinct: int
    kind: str


def _counted(df: DataFrame, approx: bool) -> list[tuple[int, int, bool]]:
    """Rows, distinct values and whether all rows differ, by column. Only columns with more values than a state counts
    exactly are counted by exchanging their values, and none with ``approx``."""
    states = sorted(column_states(df).collect(), key=lambda s: s["position"])
    many = [s["column"] for s in states if s["about"] > EXACT_VALUES]
    if approx or not many:
        near = [s["n_present"] == s["n_rows"] and s["about"] >= s["n_rows"] * (1 - STATE_ERROR) for s in states]
        same = [s["about"] >= s["n_rows"] if s["about"] <= EXACT_VALUES else all_differ for s, all_differ in zip(states, near)]
        return [(s["n_rows"], s["about"], u) for s, u in zip(states, same)]
    exact = {r["column"]: r["distinct_values"] for r in distinct_counts(df.select(*[F.col(f"`{c}`") for c in many])).collect()}
    found = [(s["n_rows"], exact.get(s["column"], s["about"])) for s in states]
    return [(n, d, d >= n) for n, d in found]


def column_kinds(df: DataFrame, approx: bool = False) -> list[ColumnKind]:
    """The probe each column deserves. Fetches a row per column.

    What groups and what does not is exact either way, since states count few values exactly. ``approx=True`` takes counts of
    many values, and whether nearly as many values as rows are all of them, from the states too.
    """
    kinds = []
    for i, (field, (n, d, all_differ)) in enumerate(zip(df.schema.fields, _counted(df, approx))):
        if is_dated(field):
            kind = "date"
        elif FEW_VALUES[0] <= d <= FEW_VALUES[1] and d < n:
            kind = "dist"
        elif is_numeric(field) and d > FEW_VALUES[1]:
            kind = "range"
        else:
            kind = "unique" if all_differ and n > 1 else "plain"
        kinds.append(ColumnKind(i, field.name, field.dataType.simpleString(), role_of(field), n, d, kind))
    return kinds


_VERDICT = "column string, varies boolean, finding string"
_PROFILE = (
    "table_name string, position int, column_name string, column_type string, role string,"
    " n_rows bigint, distinct_values bigint, kind string, varies boolean, note string"
)


def _probe_cells(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """A row per probed column and cell: ``column, kind, value`` and, of ranges, the number. Days and values are what is
    counted; a range's numbers go without one, so they add up in each task."""
    fields = {f.name: f for f in df.schema.fields}
    none = {"value": F.lit(None).cast("string"), "whole": F.lit(None).cast("bigint"), "real": F.lit(None).cast("double")}
    structs = []
    for k in kinds:
        cell, field = F.col(f"`{k.name}`"), fields[k.name]
        if k.kind == "range":
            own = {"real": cell.cast("double")} | ({} if is_float(field) else {"whole": cell.cast("bigint")})
        elif k.kind == "date":
            own = {"value": cell.cast("date").cast("string")}
        else:
            own = {"value": (cell + F.lit(0).cast(field.dataType) if is_float(field) else cell).cast("string")}
        parts = [c.alias(name) for name, c in (none | own).items()]
        structs.append(F.struct(F.lit(k.name).alias("column"), F.lit(k.kind).alias("kind"), F.lit(k.type_name).alias("type"), *parts))
    cells = df.select(F.explode(F.array(*structs)).alias("c")).select("c.*")
    return cells.where("kind <> 'date' OR value IS NOT NULL")


def _probe_findings(df: DataFrame, kinds: list[ColumnKind], top: int) -> DataFrame:
    """``column, varies, finding`` of every column with a probe: one scan, one exchange of a row per day, value or range and
    task, and one of these by column."""
    fields = {f.name: f for f in df.schema.fields}
    probed = [k for k in kinds if k.kind in ("date", "dist", "range")]
    decimals = [k.name for k in probed if k.kind == "range" and isinstance(fields[k.name].dataType, T.DecimalType)]
    together = [k for k in probed if k.name not in decimals]
    parts = []
    if decimals:  # their digits fit no number that other columns share
        ranges = numeric_range(df, decimals).select("column", F.lit(True).alias("varies"), F.concat(F.lit("continuous measure, "), "shown").alias("finding"))
        parts.append(ranges)
    if together:
        parts.append(_findings_together(df, together, top))
    if not parts:
        return df.sparkSession.createDataFrame([], _VERDICT)
    return reduce(DataFrame.unionByName, parts)


def _findings_together(df: DataFrame, kinds: list[ColumnKind], top: int) -> DataFrame:
    counted = (
        _probe_cells(df, kinds)
        .groupBy("column", "kind", "type", "value")
        .agg(
            F.count("*").alias("n"),
            F.count("real").alias("n_real"),
            F.sum("real").alias("total"),
            *[f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in ("whole", "real")],
        )
    )
    few = F.when(F.col("kind") == "dist", F.struct((-F.col("n")).alias("n"), "value"))  # as few as make a distribution
    facts = counted.groupBy("column", "kind", "type").agg(
        F.count("*").alias("n_values"),
        F.min("value").alias("first"),
        F.max("value").alias("last"),
        F.min_by("n", "value").alias("first_count"),
        (F.max("n") != F.min("n")).alias("differ"),
        F.sort_array(F.collect_list(few)).alias("values"),
        *[F.first(c).alias(c) for c in ("n_real", "total", "min_whole", "min_real", "max_whole", "max_real")],
    )

    def number(name: str) -> Column:
        real = F.col(f"{name}_real")
        text = F.when(F.col("type") == "float", real.cast("float").cast("string")).when(F.col("type") == "double", real.cast("string"))
        return F.concat(F.lit(f"{name} "), text.otherwise(F.col(f"{name}_whole").cast("string")))

    average = F.concat(F.lit("avg "), F.round(F.col("total") / F.col("n_real"), 2).cast("string"))
    listed = F.transform(F.slice("values", 1, top), lambda v: F.concat_ws("=", F.coalesce(v["value"], F.lit("null")), (-v["n"]).cast("string")))
    more = F.when(F.size("values") > top, F.format_string(" and %d more", F.size("values") - top)).otherwise("")
    finding = (
        F.when(F.col("kind") == "range", F.concat(F.lit("continuous measure, "), F.concat_ws(", ", number("min"), number("max"), average)))
        .when(
            F.col("kind") == "date",
            F.concat(
                F.format_string("%s days %s..%s, per-day count ", "n_values", "first", "last"),
                F.when(F.col("differ"), "varies").otherwise(
                    F.format_string("constant at %s: a line would be flat or straight", "first_count")
                ),
            ),
        )
        .otherwise(F.concat(F.array_join(listed, ", "), more, F.when(F.col("differ"), " (varies)").otherwise(" (all equal: flat)")))
    )
    return facts.select("column", (F.col("differ") | (F.col("kind") == "range")).alias("varies"), finding.alias("finding"))


def profile_table(df: DataFrame, name: str, approx: bool = False, top: int = SHOWN_VALUES) -> DataFrame:
    """One row per column: type, role, distinct values, kind, whether it varies, and a note naming ``top`` values.

    One aggregate decides the kinds; then one scan covers the probes of all columns.
    """
    kinds = column_kinds(df, approx)
    if not kinds[0].n_rows:
        kinds = []
    if not kinds:
        return df.sparkSession.createDataFrame([], _PROFILE)
    listing = _on_side(
        df.sparkSession.range(1),
        [
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(k.position).alias("position"),
                F.lit(k.name).alias("column"),
                F.lit(k.type_name).alias("column_type"),
                F.lit(k.role).alias("role"),
                F.lit(k.n_rows).cast("bigint").alias("n_rows"),
                F.lit(k.distinct).cast("bigint").alias("distinct_values"),
                F.lit(k.kind).alias("kind"),
            )
            for k in kinds
        ],
    )
    unique = (
        F.when(F.col("role") == "measure", "near-unique numeric: a measure")
        .otherwise("unique per row: a label, not a grouping dimension")
    )
    return listing.join(_probe_findings(df, kinds, top), "column", "left").select(
        "table_name",
        "position",
        F.col("column").alias("column_name"),
        "column_type",
        "role",
        "n_rows",
        "distinct_values",
        "kind",
        F.coalesce("varies", F.lit(False)).alias("varies"),
        F.concat_ws(
            "; ",
            F.format_string("%s distinct", "distinct_values"),
            F.when(F.col("kind") == "unique", unique).otherwise(F.col("finding")),
        ).alias("note"),
    )


def list_columns(tables: dict[str, DataFrame]) -> str:
    """The tables with their columns and types, one line per table, for a reader or a prompt."""
    return "\n".join(
        f"{name}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in tables[name].schema.fields)})"
        for name in sorted(tables)
    )


def profile_namespace(tables: dict[str, DataFrame], approx: bool = False, folder: str | None = None) -> DataFrame:
    """The profiles of several tables in one, some tables at a time side by side.

    With a ``folder`` that all executors see, each table's profile is a job of its own, written there as it is done; so the plan
    does not grow with the number of tables, and what is done stays done. Without one the result is a plan over all tables.
    """

    def profiled(name: str) -> DataFrame:
        profile = profile_table(tables[name], name, approx)
        if folder is None:
            return profile
        path = f"{folder}/table={hashlib.sha256(name.encode()).hexdigest()[:16]}"
        profile.coalesce(1).write.mode("overwrite").parquet(path)
        return profile.sparkSession.read.schema(profile.schema).parquet(path)

    with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
        profiles = list(pool.map(profiled, sorted(tables)))
    return reduce(DataFrame.unionByName, profiles)


def rank_dimensions(df: DataFrame) -> DataFrame:
    """Columns worth grouping by, those whose groups differ most in size first.

    Unique and constant columns never qualify; a column whose groups are all equal is dropped. The states say exactly which
    columns have few values, so the values of others are not exchanged.
    """
    names = [k.name for k in column_kinds(df, approx=True) if k.kind == "dist"]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, spread double, place int")
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("spread"), "column")  # a row per column at most
    return (
        distribution_verdict(df, names)
        .filter("varies")
        .select("column", "spread")
        .withColumn("place", F.row_number().over(order))
    )


def series_quality(df: DataFrame, x: str, y: str, group: str, cumulative: bool = False) -> DataFrame:
    """Whether each group's series says anything: empty, single point, flat, straight line or varies.

    Steps between neighbours decide on straightness. Rows are spread by range of ``(group, x)``, so a
    long series is cut into stretches; each stretch reports its ends and steps, and only the
    stretches of a group meet, to compare the steps between them.
    """
    tolerance = 1e-9
    rows = df.select(F.col(group).alias("_g"), F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"))
    known = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    # points that are not known go along without a step, so that a group of them alone is still reported
    points = rows.select("_g", F.when(known, F.col("_x")).alias("_x"), F.when(known, F.col("_y")).alias("_y"))
    spread = points.repartitionByRange("_g", "_x", "_y").withColumn("_stretch", F.spark_partition_id())
    along = W.partitionBy("_g", "_stretch").orderBy("_x", "_y")
    stepped = spread.withColumn("_step", F.col("_y") - F.lag("_y").over(along))
    point = F.when(F.col("_y").isNotNull(), F.struct("_x", "_y"))
    stretches = stepped.groupBy("_g", "_stretch").agg(
        F.count("_y").alias("n"),
        F.min("_y").alias("lo"),
        F.max("_y").alias("hi"),
        F.min("_step").alias("step_lo"),
        F.max("_step").alias("step_hi"),
        F.min(point).alias("head"),
        F.max(point).alias("tail"),
    )
    between = W.partitionBy("_g").orderBy("head")
    linked = stretches.withColumn("gap", F.col("head._y") - F.lag("tail._y").over(between))
    facts = linked.groupBy("_g").agg(
        F.sum("n").alias("n_points"),
        (F.max("hi") - F.min("lo")).alias("height"),
        F.least(F.min("step_lo"), F.min("gap")).alias("step_lo"),
        F.greatest(F.max("step_hi"), F.max("gap")).alias("step_hi"),
    )
    straight = (F.col("n_points") > 2) & (F.abs(F.col("step_hi") - F.col("step_lo")) <= tolerance)
    quality = (
        F.when(F.col("n_points") == 0, "empty")
        .when(F.col("n_points") == 1, "single point")
        .when(F.col("height") <= tolerance, "flat")
        .when(straight & ~F.lit(cumulative), "straight line")
        .otherwise("varies")
    )
    return facts.select(
        F.col("_g").alias(group), "n_points", quality.alias("quality")
    )
