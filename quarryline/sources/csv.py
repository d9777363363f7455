"""CSV text in and out."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import count_of

DIALECT = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8"}

# Fixed value: rows an exported chart snapshot holds when the caller asks for the usual cap.
SNAPSHOT_ROWS = 100_000


def clean_name(raw: str | None) -> str:
    """A column name made of word characters that does not start with a digit."""
    words = re.sub(r"_{2,}", "_", re.sub(r"[^A-Za-z0-9_]", "_", (raw or "").strip()))
    if not words:
        raise ValueError(f"column name {raw!r} is empty after clean-up")
    return f"c_{words}" if words[0].isdigit() else words


def clean_names(raw: list[str | None]) -> list[str]:
    """Clean names for a whole header; Spark does not tell names apart by case, so neither does this."""
    names = [clean_name(name) for name in raw]
    lowered = [name.lower() for name in names]
    twice = sorted({name for name in names if lowered.count(name.lower()) > 1})
    if twice:
        raise ValueError(f"duplicate column names after clean-up: {', '.join(twice)}")
    return names


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def drop_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Without the rows that are null in every one of the columns."""
    return df.filter(reduce(Column.__or__, [F.col(f"`{c}`").isNotNull() for c in columns or df.columns]))


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, n_lines, n_odd, spans_lines`` of every CSV file: whether a quoted cell may hold a line end, as a line with an odd
    count of quotes tells. Only such files cannot be split among tasks."""
    odd = count_of(F.col("value"), '"') % 2 == 1
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), odd.alias("odd"))
    counts = lines.groupBy("file").agg(F.count("*").alias("n_lines"), F.count_if("odd").alias("n_odd"))
    return counts.withColumn("spans_lines", F.col("n_odd") > 0)


def _as_path(uri: str) -> str:
    """A file as Spark names it, as a path that stands for this file only."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(uri))


def scan_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A headed, quoted CSV file (or folder of them) as text columns; a cell without characters is null.

    Files whose cells may span lines cannot be split among tasks. By default one pass over the text tells which files those
    are (``csv_files`` names them); all others are read in parallel. The driver gets a name per file, and only where there
    are files of both sorts.
    """
    whole = split = [path]
    if multi_line is None:
        spans = csv_files(spark, path).groupBy("spans_lines").agg(F.count("*").alias("n")).collect()
        if len(spans) < 2:
            multi_line = bool(spans and spans[0]["spans_lines"])
        else:
            files = csv_files(spark, path).select("file", "spans_lines").collect()
            whole = [_as_path(f["file"]) for f in files if f["spans_lines"]]
            split = [_as_path(f["file"]) for f in files if not f["spans_lines"]]
    reader = spark.read.options(**DIALECT)
    # Read headless first: Spark renames repeated header cells, which would hide a duplicate.
    first = reader.csv(split if multi_line is None else path, header=False, multiLine=bool(multi_line)).first()
    if first is None:
        raise ValueError("CSV needs a header row and at least one data row")
    raw = [cell.rstrip("\r") if cell else cell for cell in first]
    names = clean_names(raw)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in raw])

    def cell(name: str, spanning: bool) -> Column:
        text = F.col(name)
        if spanning:  # a file may mix line ends
            text = F.regexp_replace(F.rtrim(text, F.lit("\r")), "\r\n?", "\n")
        return F.nullif(text, F.lit("")).alias(name)

    def rows(paths: list[str], spanning: bool) -> DataFrame:
        # enforceSchema off: a further file with another header is an error, not shifted columns.
        held = reader.schema(schema).csv(paths, header=True, enforceSchema=False, multiLine=spanning).toDF(*names)
        return held.select(*[cell(name, spanning) for name in names])

    parts = [rows(whole, True)] if multi_line is not False else []
    parts += [rows(split, False)] if not multi_line else []
    table = reduce(DataFrame.union, parts)
    if table.isEmpty():
        raise ValueError("CSV needs a header row and at least one data row")
    return drop_empty_rows(table)


def _plain(field: T.StructField) -> Column:
    """A value as chart tools and the type inference read it: no exponents, no zone letters."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        text = F.substring_index(value.cast("string"), ".", 1)
    elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        wide = F.rtrim(value.try_cast("decimal(38,18)").cast("string"), F.lit("0"))
        wide = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
        text = value.cast("string")
        text = F.when(text.contains("E"), F.coalesce(wide, text)).otherwise(text)
    else:
        text = value.cast("string")
    return text.alias(field.name)


def export_snapshot(df: DataFrame, path: str, columns: list[str] | None = None, limit: int | None = None) -> None:
    """The named columns as headed CSV; ``limit=SNAPSHOT_ROWS`` gives the usual chart-sized snapshot."""
    chosen = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    if limit is not None:
        chosen = chosen.limit(limit)
    text = chosen.select(*[_plain(field) for field in chosen.schema.fields])
    text.write.mode("overwrite").options(
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path, header=True)
