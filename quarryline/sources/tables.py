"""Tables in a schema of the session catalog, kept as Parquet below the schema's folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import delete_rows, update_rows

INGESTED_AT = "_ingested_at"
SOURCE = "_source"


def business_columns(df: DataFrame) -> list[str]:
    """The columns that come from the data; names with a leading underscore record lineage."""
    return [name for name in df.columns if not name.startswith("_")]


def open_schema(spark: SparkSession, schema: str, folder: str | None = None) -> str:
    place = f" LOCATION '{folder}'" if folder else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`{place}")
    return schema


def _quoted(table: str) -> str:
    return ".".join(f"`{part}`" for part in table.split("."))


def table_columns(spark: SparkSession, table: str) -> list[str] | None:
    """Business columns of a table, or None when there is no such table; other failures are raised."""
    if not spark.catalog.tableExists(table):
        return None
    return business_columns(spark.table(table))


def replace_table(df: DataFrame, table: str) -> DataFrame:
    df.write.mode("overwrite").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


# What Spark would store by dropping a fraction or a time of day.
_LOSSY = {("double", "int"), ("double", "bigint"), ("timestamp_ntz", "date"), ("timestamp", "date")}


def append_table(df: DataFrame, table: str) -> DataFrame:
    """Rows added by column name: a column the table lacks is an error, one the rows lack is null.

    Values that the table's type would cut short are refused as well.
    """
    spark = df.sparkSession
    kept_as = {name.lower(): kind for name, kind in spark.table(table).dtypes}
    moves = [(name, kind, kept_as.get(name.lower())) for name, kind in df.dtypes]
    cut = [f"`{name}` from {kind} to {kept}" for name, kind, kept in moves if (kind, kept) in _LOSSY]
    if cut:
        raise ValueError(f"cannot append to `{table}`: values would be cut short in {', '.join(cut)}")
    spark.sql(f"INSERT INTO {_quoted(table)} BY NAME SELECT * FROM {{rows}}", rows=df)
    return spark.table(table)


def with_lineage(df: DataFrame, source: str | Column, at: Column | None = None) -> DataFrame:
    """When and from where each row was loaded."""
    name = F.lit(source) if isinstance(source, str) else source
    return df.withColumn(INGESTED_AT, at if at is not None else F.current_timestamp()).withColumn(SOURCE, name)


def _check_mode(mode: str) -> None:
    if mode not in ("replace", "append"):
        raise ValueError(f"unknown mode {mode!r}: replace or append")


def load_bronze(df: DataFrame, name: str, source: str, mode: str = "replace") -> DataFrame:
    """``<name>_bronze``: the rows as they came, with lineage. Append creates the table when needed."""
    _check_mode(mode)
    table = f"{name}_bronze"
    rows = with_lineage(df, source)
    if mode == "append" and df.sparkSession.catalog.tableExists(table):
        return append_table(rows, table)
    return replace_table(rows, table)


def load_flat(df: DataFrame, name: str, mode: str = "replace") -> tuple[int, int]:
    """A table of exactly this name and these columns; returns rows inserted and rows it now holds.

    The counts come from Parquet footers, not from reading the rows again.
    """
    _check_mode(mode)
    spark = df.sparkSession
    if mode == "replace":
        total = replace_table(df, name).count()
        return total, total
    existing = table_columns(spark, name)
    if existing is None:
        raise ValueError(f"table `{name}` does not exist yet; load it as a new table")
    known = {column.lower() for column in existing}
    missing = [column for column in df.columns if column.lower() not in known]
    if missing:
        raise ValueError(
            f"cannot append to `{name}`: it has no column {', '.join(f'`{m}`' for m in missing)}; "
            f"its columns are {', '.join(f'`{e}`' for e in existing)}"
        )
    before = spark.table(name).count()
    after = append_table(df, name).count()
    return after - before, after


def rewrite_table(
    spark: SparkSession, table: str, predicate: str, assignments: dict[str, str] | None = None, confirm: bool = False
) -> int:
    """Copy-on-write change of a stored table: the rows the predicate holds for are deleted or, with ``assignments``,
    updated. Returns how many they were, counted as the new copy is written.

    The old copy keeps its data under ``<table>__old`` until the new one has its name, and gets its name back if that fails.
    """
    if not confirm:
        raise PermissionError(f"changing `{table}` needs confirmation")
    rows, met = spark.table(table), Observation()
    counted = rows.observe(met, F.count_if(F.expr(predicate)).alias("n"))
    staged, old = f"{table}__next", f"{table}__old"
    replace_table(delete_rows(counted, predicate) if assignments is None else update_rows(counted, assignments, predicate), staged)
    affected = met.get["n"]
    if not affected:
        spark.sql(f"DROP TABLE {_quoted(staged)}")
        return 0
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(old)}")
    spark.sql(f"ALTER TABLE {_quoted(table)} RENAME TO {_quoted(old)}")
    try:
        spark.sql(f"ALTER TABLE {_quoted(staged)} RENAME TO {_quoted(table)}")
    except Exception:
        spark.sql(f"ALTER TABLE {_quoted(old)} RENAME TO {_quoted(table)}")
        raise
    spark.sql(f"DROP TABLE {_quoted(old)}")
    return affected
