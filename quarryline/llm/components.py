"""Connected components of a table of links, by union-find inside partitions and merging of roots between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import workspace


def _find(parent: dict[int, int], node: int) -> int:
    root = node
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(node, node) != root:
        parent[node], node = root, parent[node]
    return root


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as a star forest: each node with the least node it is connected to here."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((_find(parent, a), _find(parent, b)))
            if low != high:
                parent[high] = low
    nodes = list(parent)
    roots = [_find(parent, node) for node in nodes]
    for i in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[i : i + 10_000], pa.int64()), pa.array(roots[i : i + 10_000], pa.int64())], ["node", "root"]
        )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (its first two columns, longs) but the least of its component, which is
    ``root``. Links to oneself and repeated links change nothing; no links give no rows.

    Each round joins links inside partitions by union-find, keeps each node's least root, links its other roots to that
    one, and lets roots that have a root themselves pass it on. It ends when every node has one root which is no node. A
    partition holds its own links only; each round is a table below ``spark.checkpoint.dir``.
    """
    spark = links.sparkSession
    a, b = (F.col(c).cast("long") for c in links.columns[:2])
    forest = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node > root").distinct()
    while True:
        local_path = workspace(spark, "union")
        forest.mapInArrow(_local, "node long, root long").write.parquet(local_path)
        local = spark.read.parquet(local_path)
        low = local.groupBy("node").agg(F.min("root").alias("low"))
        merged = (
            local.join(low, "node")
            .select(F.explode(F.array(F.struct("node", F.col("low").alias("root")), F.struct(F.col("root").alias("node"), F.col("low").alias("root")))).alias("e"))
            .select("e.*")
            .where("node > root")
            .distinct()
        )
        merged_path = workspace(spark, "union")
        merged.write.parquet(merged_path)
        merged = spark.read.parquet(merged_path)
        above = merged.groupBy("node").agg(F.min("root").alias("above"), F.count("*").alias("n"))
        open_roots = merged.join(above.select(F.col("node").alias("root")), "root", "left_semi")
        if open_roots.isEmpty() and above.where("n > 1").isEmpty():
            return merged
        forest = (
            merged.join(above.select(F.col("node").alias("root"), "above"), "root", "left")
            .select("node", F.coalesce("above", "root").alias("root"))
            .union(merged.select("node", "root"))
            .distinct()
        )
