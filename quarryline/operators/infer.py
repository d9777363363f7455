"""Finding the type of text columns from every value they hold, and casting to it."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The shapes a text value is recognised by, and the largest value of an INT column.
NUMBER = r"^-?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?\z"
GROUPED = r"^-?\d{1,3}(,\d{3})+(\.\d+)?\z"
TRUTHS = ("true", "false")
DATED = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?\z"
DAY_LENGTH, MOMENT_LENGTHS = 10, (16, 19)
INT_LIMIT = 2147483647

# Type names of the portable vocabulary and the Spark types they are stored as.
SPARK_TYPES = {
    "INT": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "DATETIME": "timestamp_ntz",
    "DATE": "date",
    "TEXT": "string",
}

# One bit per shape, so that a single bit_or per column holds the set of shapes seen.
_SMALL, _BIG, _FRACTION, _TRUTH, _MOMENT, _DAY, _OTHER = (1 << i for i in range(7))


def ungroup_number(text: Column) -> Column:
    """``1,476,625`` as ``1476625``; anything that is not a grouped number is left alone."""
    return F.when(text.contains(",") & text.rlike(GROUPED), F.replace(text, F.lit(","), F.lit(""))).otherwise(text)


def _shape(text: Column) -> Column:
    """The one shape a non-empty value has. First character and length are looked at before any pattern."""
    first = F.ascii(text)
    numeric_start = first.between(48, 57) | (first == 45)  # a digit or a minus
    length = F.length(text)
    digits = F.replace(text, F.lit(","), F.lit(""))
    return (
        F.when(
            numeric_start,
            F.when(
                length.isin(DAY_LENGTH, *MOMENT_LENGTHS) & text.rlike(DATED),
                F.when(length == DAY_LENGTH, _DAY).otherwise(_MOMENT),
            )
            .when(~text.rlike(NUMBER), _OTHER)
            .when(text.contains("."), _FRACTION)
            .when(length <= 9, _SMALL)
            .when(F.abs(digits.try_cast("double")) > INT_LIMIT, _BIG)
            .otherwise(_SMALL),
        )
        .when(length.isin(4, 5) & F.lower(text).isin(*TRUTHS), _TRUTH)
        .otherwise(_OTHER)
    )


def _type_name(shapes: Column, longest: Column) -> Column:
    def only(allowed: int) -> Column:
        return shapes.bitwiseAND(F.lit(~allowed)) == 0

    sized = F.concat(
        F.lit("VARCHAR("), F.least(F.greatest(longest * 2, F.lit(32)), F.lit(1000)).cast("string"), F.lit(")")
    )
    return (
        F.when(shapes == 0, "TEXT")
        .when(only(_SMALL), "INT")
        .when(only(_SMALL | _BIG), "BIGINT")
        .when(only(_SMALL | _BIG | _FRACTION), "DOUBLE")
        .when(only(_TRUTH), "BOOLEAN")
        .when(only(_MOMENT), "DATETIME")
        .when(only(_DAY), "DATE")
        .when(longest > 1000, "TEXT")
        .otherwise(sized)
    )


def spark_type(inferred: Column) -> Column:
    known = reduce(
        lambda chain, pair: chain.when(inferred == pair[0], pair[1]),
        SPARK_TYPES.items(),
        F.when(F.lit(False), F.lit(None).cast("string")),
    )
    return known.otherwise("string")


def infer_states(df: DataFrame) -> DataFrame:
    """``position, column, shapes, longest, n_present`` of every text column: the shapes its values have, a bit for each, the
    longest value and how many there are. States of parts make up the state of the whole (``merge_states``).

    The table is read once, turned on its side and reduced to one row per column in each task, so
    the exchange is tiny and the generated code does not grow with the number of columns.
    """
    names = df.columns
    listing = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("position", "column"))
    text = F.col("value")
    facts = (
        df.unpivot([], [F.col(f"`{name}`") for name in names], "column", "value")
        .filter(text != "")
        .groupBy("column")
        .agg(
            F.bit_or(_shape(text)).alias("shapes"),
            F.max(F.length(text)).alias("longest"),
            F.count(text).alias("n_present"),
        )
    )
    return listing.join(facts, "column", "left").select(
        "position", "column", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("shapes", "longest", "n_present")]
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state per column from any number of them; a column stands where it first stood."""
    return states.groupBy("column").agg(
        F.min("position").alias("position"),
        F.bit_or("shapes").alias("shapes"),
        F.max("longest").alias("longest"),
        F.sum("n_present").alias("n_present"),
    )


def types_of(states: DataFrame) -> DataFrame:
    """One row per column: its position, inferred type, Spark type, longest value, values present."""
    inferred = states.withColumn("inferred", _type_name(F.col("shapes"), F.col("longest")))
    return inferred.select(
        "position", "column", "inferred", spark_type(F.col("inferred")).alias("spark_type"), "longest", "n_present"
    )


def infer_types(df: DataFrame) -> DataFrame:
    """The type of every text column from all its values; see ``types_of``."""
    return types_of(infer_states(df))


def remember_states(df: DataFrame, folder: str, source: str) -> None:
    """Keeps the states of one file's columns below ``folder``, in place of those kept for the same source before."""
    name = hashlib.sha256(source.encode()).hexdigest()
    states = infer_states(df).withColumn("source", F.lit(source))
    states.coalesce(1).write.mode("overwrite").parquet(f"{folder}/state={name}")


def remembered_types(spark: SparkSession, folder: str) -> DataFrame:
    """The types of all files remembered below ``folder``, as if inferred from them together; no file is read again.

    A column that some files lack has the type of those that have it.
    """
    return types_of(merge_states(spark.read.parquet(folder)))


def collect_types(inferred: DataFrame) -> dict[str, str]:
    """Column name to inferred type; as many rows as the table has columns."""
    return {row["column"]: row["inferred"] for row in inferred.orderBy("position").collect()}


def _cast(text: Column, inferred: str) -> Column:
    present = F.when(text != "", text)
    kind = re.sub(r"\(.*", "", inferred)
    if kind in ("INT", "BIGINT", "DOUBLE"):
        return ungroup_number(present).try_cast(SPARK_TYPES[kind])
    if kind == "BOOLEAN":
        return F.when(F.lower(present).isin(*TRUTHS), F.lower(present) == "true")
    if kind in ("DATETIME", "DATE"):
        return present.try_cast(SPARK_TYPES[kind])
    return present


def cast_typed(df: DataFrame, types: dict[str, str], strict: bool = True) -> DataFrame:
    """Every column cast to its inferred type in one projection.

    A value that fits the shape but not the type (``2026-13-45``, an integer past 64 bits) stops the
    job and names its column; ``strict=False`` makes it null, to be counted by ``cast_failures``.
    """
    out = []
    for name in df.columns:
        text, inferred = F.col(f"`{name}`"), types[name]
        value = _cast(text, inferred)
        if strict and SPARK_TYPES.get(inferred, "string") != "string":
            stop = F.raise_error(F.concat(F.lit(f"column {name}: not a valid {inferred}: "), text))
            value = F.when((text != "") & value.isNull(), stop.cast(SPARK_TYPES[inferred])).otherwise(value)
        out.append(value.alias(name))
    return df.select(*out)


def cast_failures(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per column, how many present values its inferred type cannot hold."""
    counts = df.agg(
        *[
            F.count_if((F.col(f"`{name}`") != "") & _cast(F.col(f"`{name}`"), types[name]).isNull()).alias(f"bad_{i}")
            for i, name in enumerate(df.columns)
        ]
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("column"),
                        F.lit(types[name]).alias("inferred"),
                        F.col(f"bad_{i}").alias("failures"),
                    )
                    for i, name in enumerate(df.columns)
                ]
            )
        )
    )
