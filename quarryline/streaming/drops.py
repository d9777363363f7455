"""Files dropped into a folder, loaded as they come."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.commands import filters_in_force, normalize_commands
from ..operators.infer import cast_typed
from ..sources.csv import DIALECT, drop_empty_rows
from ..sources.tables import with_lineage
from ..sources.versions import StoredTable


def stream_bronze(
    spark: SparkSession, folder: str, types: dict[str, str], out: str, checkpoint: str, multi_line: bool = False
) -> None:
    """Loads the CSV files not yet loaded into the Parquet table at ``out``, with lineage, then returns.

    ``types`` are the inferred types by column, in file order; a file whose header says otherwise stops the stream before
    any of its rows are loaded. The checkpoint remembers which files are done, so running again loads none twice, also
    after a crash in the middle. Only where cells span lines, ``multi_line=True`` is needed; each file is one task then.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in types])
    files = spark.readStream.schema(schema).options(**DIALECT, multiLine=multi_line).csv(folder, header=True, enforceSchema=False)
    cells = files.select(
        *[F.nullif(F.col(f"`{name}`"), F.lit("")).alias(name) for name in types],
        F.col("_metadata.file_name").alias("_file"),
    )
    typed = cast_typed(drop_empty_rows(cells, list(types)), {**types, "_file": "TEXT"})
    loaded = with_lineage(typed, F.col("_file")).drop("_file")
    query = (
        loaded.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_commands(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Normalises the command files not yet seen: the checkpoint takes the place of a reader's cursor.

    Files hold one JSON object ``{"seq", "command_id", "body"}`` per line.
    """
    sent = spark.readStream.schema("seq bigint, command_id string, body string").json(folder)
    query = (
        normalize_commands(sent)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_filters(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Brings the filters in force, a stored table at ``out``, up to date with the command files not yet seen.

    The last command per worksheet and field is the stream's state, which the checkpoint keeps: earlier files are not read
    again, and a run that stopped in the middle goes on from there. Every version of the table is whole, so readers find the
    filters before or after a run of files.
    """
    sent = spark.readStream.schema("seq bigint, command_id string, body string").json(folder)
    table = StoredTable(spark, out)
    query = (
        filters_in_force(normalize_commands(sent))
        .writeStream.foreachBatch(lambda batch, number: table.replace(batch.coalesce(1)))
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
