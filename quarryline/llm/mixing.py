"""Mixing sources to target weights by thresholds on a hash of each row, found from histograms.

Every source gets a share of the words. A source whose share is over its size is taken whole so many times as fit; of the
rest, the rows whose hash lies below the source's threshold are taken once more. Thresholds are nested: with a larger share
a source keeps all rows it had. Words are summed by source and the hash's first digits; the bucket in which the share
runs out, and no other, is looked at with more digits, until it holds one row. Rows are never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import workspace

#: Hexadecimal digits by which a bucket is refined: 4,096 buckets a source and level.
DIGITS = 3
_WORD = r"[^\x20\x09-\x0D]+"


def _stored(df: DataFrame, label: str) -> DataFrame:
    spark, path = df.sparkSession, workspace(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0, by code point and null last: ranges are sorted in their tasks and begin behind each other."""
    order = F.col("source").asc_nulls_last()
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    dealt = _stored(sources.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("at", at), "mix-sources")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    begins = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(begins, "part").select("source", "source_size", (F.col("begin") + inside).alias("rank"))


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times all words by them. A target stops
    at ``most`` times its source's size; what is over is shared again until no target is above. Each round is one sum over
    the sources and stops at least one more of them.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(listed, (F.col("rank") % len(weights) + 1).cast("int"))
    known = _stored(_ranked(sources).withColumn("weight", weight), "mix-weights")
    ceiling = F.col("source_size") * F.lit(float(most))
    words, total = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    left, open_weight = share * words, total
    while True:
        stopped = ceiling * open_weight <= F.col("weight") * left
        over, still = known.agg(F.sum(F.when(stopped, ceiling)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if still is None or still == open_weight:
            break
        left, open_weight = share * words - (over or 0.0), still
    return known.select("source", "source_size", F.when(stopped, ceiling).otherwise(F.col("weight") * left / open_weight).alias("target"))


def _cuts(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``source, cut, take``: of a source with a share over, the first digits that only its last row has, and whether that
    row is taken, as it is when more than half of it fits."""
    level, found, depth = rows, [], 0
    bounds = shares.select("source", "extra").where("extra > 0").withColumn("cut", F.lit("")).withColumn("base", F.lit(0).cast("long"))
    while not bounds.isEmpty():
        here = bounds.select(F.col("source").alias("b_source"), "extra", F.col("cut").alias("b_cut"), "base")
        inside = F.col("source").eqNullSafe(F.col("b_source")) & (F.substring("key", 1, depth) == F.col("b_cut"))
        level = level.join(here, inside).select("source", "key", "size", "extra", "base")
        if depth:
            level = _stored(level, "mix-bucket")
        depth += DIGITS
        buckets = level.groupBy("source", F.substring("key", 1, depth).alias("cut"), "extra", "base").agg(
            F.sum("size").alias("words"), F.count("*").alias("n")
        )
        before = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("cut")) - F.col("words")
        last = buckets.withColumn("before", before).where("before <= extra and before + words > extra")
        last = _stored(last.select("source", "cut", "extra", "before", "words", "n"), "mix-bounds")
        found.append(last.where("n = 1").select("source", "cut", F.expr("2 * (extra - before) > words").alias("take")))
        bounds = last.where("n > 1").select("source", "extra", "cut", F.col("before").alias("base"))
        level = level.select("source", "key", "size")
    return reduce(DataFrame.union, found) if found else shares.select("source", F.lit("").alias("cut"), F.lit(False).alias("take")).limit(0)


def mix(documents: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per row of ``documents`` (columns ``doc_id``, ``text`` and ``source``; others are ignored): ``doc_id,
    size, source_size, target, taken, times``.

    ``size`` is the number of words, ``target`` the words that the mix wants of the row's source (see ``targets``),
    ``times`` how often the mix takes the row and ``taken`` its words by that. A source's taken words miss its target by
    half of one row at most; no row is taken more than ``most`` times.

    The hash is of ``doc_id`` and text, so the same rows are chosen on every run and in any order. Of rows that are equal
    in both, which are alike in the result too, as many are taken as fit. A null text has no words, a null source is a
    source of its own, a null ``doc_id`` is carried along, and an empty table gives an empty table.
    """
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce("text", F.lit("")))
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    slim = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"), F.md5(name).alias("digest"))
    rows = _stored(slim, "mix-rows")
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))
    shares = wanted.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0))
    over = F.when(F.col("whole") < most, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)
    shares = _stored(shares.withColumn("extra", over), "mix-shares")
    key = F.concat("digest", F.md5(F.col("row").cast("string")))
    cuts = _cuts(rows.select("source", key.alias("key"), "size"), shares)
    plan = _stored(_by_source(shares, cuts, ["cut", "take"]), "mix-plan")
    return _by_source(rows, plan, ["source_size", "target", "whole", "cut", "take"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _times(key)).alias("taken"), _times(key).alias("times")
    )


def _by_source(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    right = right.select(F.col("source").alias("r_source"), *columns)
    return left.join(right, F.col("source").eqNullSafe(F.col("r_source")), "left").drop("r_source")


def _times(key: Column) -> Column:
    start = F.substring(key, F.lit(1), F.length("cut"))
    below = (start < F.col("cut")) | ((start == F.col("cut")) & F.col("take"))
    return F.col("whole") + F.coalesce(below, F.lit(False)).cast("long")
