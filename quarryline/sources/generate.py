"""Invented rows for trying things out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ROWS = 20
# Rows of one chunk: enough to be worth a task, and of the order of the number of chunks.
_CHUNK = "greatest(10000, cast(ceil(sqrt(_wanted)) as bigint))"


@dataclass(frozen=True)
class Field:
    """A column to invent: one of ``choices``, else a whole number, amount or day in ``low..high``.

    ``kind`` is ``choice``, ``number``, ``amount`` (two decimals) or ``day`` (days after ``start``).
    """

    name: str
    kind: str
    choices: tuple[str, ...] = ()
    low: int = 0
    high: int = 100
    start: str = "2026-01-01"

    def column(self, draw: Column) -> Column:
        if self.kind == "choice":
            return F.array(*[F.lit(c) for c in self.choices])[F.pmod(draw, F.lit(len(self.choices))).cast("int")]
        step = F.pmod(draw, F.lit(self.high - self.low + 1)) + F.lit(self.low)
        if self.kind == "number":
            return step.cast("bigint")
        if self.kind == "amount":
            return F.round(step / 100, 2)
        if self.kind == "day":
            return F.date_add(F.lit(self.start).cast("date"), step.cast("int"))
        raise ValueError(f"unknown field kind {self.kind!r}")


def _drawn(fields: list[Field], request: Column) -> list[Column]:
    """Each value is drawn by modulo from request, row number and the column's position."""
    return [
        field.column(request * 31 + F.col("row_no") * 17 + F.lit(position * 7)).alias(field.name)
        for position, field in enumerate(fields)
    ]


def synthetic_rows(requests: DataFrame, fields: list[Field], request_id: str, n_rows: str | None = None) -> DataFrame:
    """The requested number of rows for every request, the same on each run.

    A large request is cut into chunks that are spread over the cluster before rows are made.
    """
    wanted = F.coalesce(F.col(n_rows), F.lit(DEFAULT_ROWS)) if n_rows else F.lit(DEFAULT_ROWS)
    chunks = (
        requests.select(F.col(request_id), wanted.cast("bigint").alias("_wanted"))
        .filter("_wanted > 0")
        .select("*", F.expr(_CHUNK).alias("_step"))
        .select("*", F.explode(F.expr("sequence(0, _wanted - 1, _step)")).alias("_from"))
        .repartition(request_id, "_from")
    )
    rows = chunks.select(
        request_id, F.explode(F.expr("sequence(_from, least(_from + _step, _wanted) - 1)")).alias("row_no")
    )
    return rows.select(request_id, "row_no", *_drawn(fields, F.col(request_id)))


def synthetic_table(spark: SparkSession, fields: list[Field], n: int = DEFAULT_ROWS) -> DataFrame:
    """One table of n invented rows."""
    return spark.range(n).withColumnRenamed("id", "row_no").select(*_drawn(fields, F.lit(0)))
