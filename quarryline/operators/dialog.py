"""Conversations as text, and groups in a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# speakers' names and the text of a conversation nobody spoke in.
CALLERS = ("user", "human")
CALLER_NAME, OTHER_NAME = "You", "Agent"
NO_TRANSCRIPT = "_(empty transcript)_"
TURNS_PER_PART = 10_000


def transcripts(turns: DataFrame, message: str | None = None, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """The script of every conversation from its turns ``(conv_id, turn, role, text)``.

    A conversation of up to ``turns_per_part`` spoken lines is one row, whatever its turn numbers. A longer one continues in
    further parts, in order, so that no task ever has to hold all of it; nothing is left out. Lines without a turn come
    first, lines of one turn in the order of their text. ``message`` names a column that goes before ``text`` where it is
    filled.
    """
    said = F.coalesce(F.col(message), F.col("text")) if message else F.col("text")
    who = F.when(F.col("role").isin(*CALLERS), CALLER_NAME).otherwise(OTHER_NAME)
    spoken = turns.select("conv_id", "turn", F.concat(who, F.lit(": "), F.nullif(said, F.lit(""))).alias("line"))
    # places in two steps, so that a conversation is numbered by many tasks: inside stretches, then stretch by stretch
    stretched = (
        spoken.filter(F.col("line").isNotNull())
        .repartitionByRange("conv_id", "turn", "line")
        .withColumn("_stretch", F.spark_partition_id())
    )
    inside = stretched.withColumn("_i", F.row_number().over(W.partitionBy("conv_id", "_stretch").orderBy("turn", "line")))
    sizes = inside.groupBy("conv_id", "_stretch").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("conv_id").orderBy("_stretch")) - F.col("_n"))
    placed = inside.withColumnRenamed("conv_id", "_conv").join(
        before.select(F.col("conv_id"), F.col("_stretch").alias("_s"), "_before"),
        F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_stretch") == F.col("_s")),
    )
    part = F.expr(f"(_before + _i - 1) div {int(turns_per_part)}").alias("part")
    lines = F.sort_array(F.collect_list(F.struct("turn", "line")))
    scripts = placed.groupBy("conv_id", part).agg(
        F.array_join(F.transform(lines, lambda t: t["line"]), "\n").alias("transcript"), F.count("*").alias("n_lines")
    )
    silent = (
        spoken.groupBy("conv_id")
        .agg(F.count("line").alias("n_lines"))
        .filter("n_lines = 0")
        .select("conv_id", F.lit(0).cast("bigint").alias("part"), F.lit(NO_TRANSCRIPT).alias("transcript"), "n_lines")
    )
    return scripts.unionByName(silent)


def spoken_row(columns: list[str]) -> Column:
    """A row in words: each column's name and value."""
    return F.concat_ws(
        ", ",
        *[F.concat(F.lit(f"{c} "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))) for c in columns],
    )


def spoken_digest(df: DataFrame, group: str, columns: list[str], order: list[Column], intro: Column | None = None) -> DataFrame:
    """A sentence per group: its first three rows in words and how many more there are.

    A group of one row and one column is answered outright. Rows are cut to three per group in each
    task before the exchange; the counts are grouped on their own and meet them on the same key.
    """
    ranked = df.select(
        group, spoken_row(columns).alias("_words"), F.row_number().over(W.partitionBy(group).orderBy(*order)).alias("_place"),
        F.col(f"`{columns[0]}`").cast("string").alias("_first"),
    ).filter(F.col("_place") <= 3)
    words = F.sort_array(F.collect_list(F.struct("_place", "_words")))
    top = ranked.groupBy(group).agg(
        F.array_join(F.transform(words, lambda r: r["_words"]), "; ").alias("_top"),
        F.min_by("_first", "_place").alias("_first"),
    )
    counts = df.groupBy(group).agg(F.count("*").alias("n_rows"))
    opening = F.concat(intro, F.lit(" ")) if intro is not None else F.lit("")
    more = F.when(F.col("n_rows") > 3, F.format_string(" And %s more.", F.col("n_rows") - 3)).otherwise("")
    listed = F.concat(F.lit("Top results: "), F.col("_top"), F.lit("."), more)
    if len(columns) == 1:
        answer = F.concat(F.lit("The answer is "), F.coalesce("_first", F.lit("null")), F.lit("."))
        listed = F.when(F.col("n_rows") == 1, answer).otherwise(listed)
    return (
        counts.withColumnRenamed(group, "_group")
        .join(top, F.col("_group").eqNullSafe(F.col(group)))
        .select(group, "n_rows", F.concat(opening, listed).alias("digest"))
    )


def digest_nothing(intro: str) -> str:
    """What is said when there are no rows, and so no group to say it for."""
    return f"{intro} No rows matched."
