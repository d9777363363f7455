"""Silver and gold kept current from the bronze rows that are new, without building them again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate_alias, aggregation_name
from ..operators.medallion import choose_dimension
from ..sources.csv import drop_empty_rows
from ..sources.tables import INGESTED_AT
from ..sources.versions import KeyedTable

# Aggregates that the values themselves are needed for; the others add up.
_BY_VALUE = ("COUNTD", "MIN", "MAX")


@dataclass(frozen=True)
class LayerSpec:
    """What silver is keyed by (several columns, or none: the whole row), and what gold says about it."""

    columns: list[str]
    key: list[str] | None = None
    dimension: str | None = None
    measure: str | None = None
    aggregation: str = "COUNT"
    buckets: int = 64

    def keys(self) -> list[str]:
        return self.key or self.columns


def _silver(spark: SparkSession, out: str, spec: LayerSpec) -> KeyedTable:
    return KeyedTable(spark, f"{out}/silver", spec.keys(), spec.buckets)


def _groups(spark: SparkSession, out: str, spec: LayerSpec) -> KeyedTable:
    keys = ["_group", "_value"] if aggregation_name(spec.aggregation) in _BY_VALUE else ["_group"]
    return KeyedTable(spark, f"{out}/groups", keys, spec.buckets)


def _latest(names: list[str], keys: list[str], changes: str):
    """Merges rows into the latest per key, and leaves what that changed in a table at ``changes``: of each key concerned the
    row that goes, if any, and the row that comes."""

    def combine(rows: DataFrame) -> DataFrame:
        ties = [name for name in names if name not in (*keys, INGESTED_AT)]
        whole = F.struct(*[F.col(f"`{c}`") for c in (INGESTED_AT, *ties)])
        # The greatest structure is the row that comes first by these columns, each descending and null last.
        merged = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
            F.max(whole).alias("_latest"), F.max(F.when(~F.col("_new"), whole)).alias("_held")
        )
        spark = rows.sparkSession
        merged.write.parquet(changes)
        merged = spark.read.parquet(changes)
        return merged.select(*[F.col(f"`{k}`") for k in keys], "_latest.*")

    return combine


def _moved(spark: SparkSession, changes: str, spec: LayerSpec, dimension: str) -> DataFrame:
    """Rows that silver lost and got, as ``_group, _value, sign``. With a key, a held row may have given way to a later one;
    without, the rows of a key are alike and only new ones come."""
    merged = spark.read.parquet(changes)

    def side(row: str, sign: int) -> DataFrame:
        def value(name: str | None) -> Column:
            if name is None:
                return F.lit(None).cast("string")
            return F.col(f"`{name}`") if name in spec.keys() else F.col(f"{row}.`{name}`")

        return merged.where(present[row]).select(
            value(dimension).alias("_group"), value(spec.measure).alias("_value"), F.lit(sign).alias("sign")
        )

    differs = ~F.col("_held").eqNullSafe(F.col("_latest"))
    if spec.key is None:  # of equal rows the time of loading may differ, which is no change
        differs = F.col("_held").isNull()
    present = {"_held": differs & F.col("_held").isNotNull(), "_latest": differs}
    return side("_held", -1).unionByName(side("_latest", 1))


def _added(spec: LayerSpec):
    """Merges signed sums; a group without rows is gone."""
    keys = ["_group", "_value"] if aggregation_name(spec.aggregation) in _BY_VALUE else ["_group"]

    def combine(rows: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in rows.columns if c not in (*keys, "_new")]
        return rows.groupBy(*keys).agg(*sums).where("n_rows <> 0")

    return combine


def _states(moved: DataFrame, spec: LayerSpec) -> DataFrame:
    kind = aggregation_name(spec.aggregation)
    if kind in _BY_VALUE:
        return moved.groupBy("_group", "_value").agg(F.sum("sign").cast("bigint").alias("n_rows"))
    facts = {"n_rows": F.col("sign")}
    if kind != "COUNT":
        facts |= {"n_present": F.when(F.col("_value").isNotNull(), F.col("sign")), "total": F.col("_value") * F.col("sign")}
    return moved.groupBy("_group").agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(n) for n, f in facts.items()])


def append_layers(batch: DataFrame, number: int, out: str, spec: LayerSpec) -> None:
    """Brings silver and gold below ``out`` up to date with a batch of bronze rows, which carry ``_ingested_at``.

    Each table's newest version says which batch it holds. A batch that comes again, after a failure between the two tables or
    in the middle of one, is taken up where it stopped and counted once.
    """
    spark, names = batch.sparkSession, spec.columns
    silver, groups = _silver(spark, out, spec), _groups(spark, out, spec)
    if silver.notes().get("batch", -1) < number:
        rows = drop_empty_rows(batch, names).select(*[F.col(f"`{c}`") for c in names], INGESTED_AT)
        changes = f"{out}/changes/{number}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{changes}/rows")  # the source is read once
        rows, changes = spark.read.parquet(f"{changes}/rows"), f"{changes}/merged"
        silver.merge(rows, _latest(names, spec.keys(), changes), {"batch": number, "changes": changes})
    if groups.notes().get("batch", -1) < number:
        dimension = spec.dimension or groups.notes().get("dimension") or choose_dimension(silver.read().select(*names))
        moved = _moved(spark, silver.notes()["changes"], spec, dimension)
        groups.merge(_states(moved, spec), _added(spec), {"batch": number, "dimension": dimension})


def read_silver(spark: SparkSession, out: str, spec: LayerSpec) -> DataFrame:
    return _silver(spark, out, spec).read().select(*[F.col(f"`{c}`") for c in spec.columns])


def read_gold(spark: SparkSession, out: str, spec: LayerSpec) -> DataFrame:
    """What ``promote_gold`` would give over silver, from the states of its groups."""
    groups, kind = _groups(spark, out, spec), aggregation_name(spec.aggregation)
    states, name = groups.read(), aggregate_alias(spec.aggregation, spec.measure)
    group = F.col("_group").alias(groups.notes()["dimension"])
    if kind in _BY_VALUE:
        made = {"COUNTD": F.count("_value"), "MIN": F.min("_value"), "MAX": F.max("_value")}[kind]
        return states.groupBy(group).agg(made.alias(name))
    total = F.when(F.col("n_present") > 0, F.col("total"))
    made = F.col("n_rows") if kind == "COUNT" else total if kind == "SUM" else total / F.col("n_present")
    return states.select(group, made.alias(name))


def stream_layers(spark: SparkSession, bronze: str, out: str, checkpoint: str, spec: LayerSpec) -> int:
    """Takes the files of the Parquet table at ``bronze`` that are new into silver and gold below ``out``, then returns how
    many rows were read. Rows of earlier files are not read again."""
    schema = spark.read.parquet(bronze).schema
    missing = [c for c in (*spec.columns, INGESTED_AT) if c not in schema.names]
    if missing:
        raise ValueError(f"bronze has no column {', '.join(missing)}")
    query = (
        spark.readStream.schema(schema)
        .parquet(bronze)
        .writeStream.foreachBatch(lambda batch, number: append_layers(batch, number, out, spec))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)

