"""Queries for the bronze, silver and gold layers (B1-B6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.medallion import choose_dimension, dedup_latest, dimension_scores, promote_gold, promote_silver
from ..plans.build import build_layers
from ..session import workspace
from ..sources.tables import with_lineage
from ..streaming.layers import LayerSpec, read_gold, stream_layers
from .base import Check, table
from .ingest import new_schema


def _dedup_latest(spark, sf):
    events = table(spark, sf, "events")
    return dedup_latest(events, ["user_id", "event_type"], ["ts", "event_id"])


_DEDUP_SQL = """
SELECT event_id, ts, user_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""


def _two_loads(spark, sf) -> DataFrame:
    """Orders loaded twice: the second load has pending orders finished, and a row without values."""
    orders = table(spark, sf, "orders")
    finished = F.when(F.col("o_orderstatus") == "P", F.lit("F")).otherwise(F.col("o_orderstatus"))
    empty = F.col("o_totalprice") < 10000
    second = orders.withColumn("o_orderstatus", finished).select(
        *[F.when(~empty, F.col(c)).alias(c) for c in orders.columns]
    )

    def at(hour: int):
        return F.lit(f"2026-07-01 0{hour}:00:00").cast("timestamp_ntz")

    return with_lineage(orders, "first.csv", at(1)).unionByName(with_lineage(second, "second.csv", at(2)))


_LOADS_SQL = """
WITH loads AS (
  SELECT *, 1 AS load FROM orders
  UNION ALL
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END,
         o_totalprice, o_orderdate, o_orderpriority, 2 FROM orders WHERE o_totalprice >= 10000)"""


_APPENDED = LayerSpec(
    ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], ["o_orderkey"], "o_orderstatus", "o_totalprice",
    "SUM", buckets=8,
)


def _appended(spark, sf) -> DataFrame:
    """Gold after three loads: all orders, then pending ones finished, then a fifth of them at twice the price."""
    place = workspace(spark, "appended")
    dearer = table(spark, sf, "orders").filter("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    third = with_lineage(dearer, "third.csv", F.lit("2026-07-01 03:00:00").cast("timestamp_ntz"))
    loads = _two_loads(spark, sf)
    for load in (loads.filter("_source = 'first.csv'"), loads.filter("_source = 'second.csv'"), third):
        load.write.mode("append").parquet(f"{place}/bronze")
        stream_layers(spark, f"{place}/bronze", f"{place}/layers", f"{place}/checkpoint", _APPENDED)
    return read_gold(spark, f"{place}/layers", _APPENDED).withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


def _choose(spark, sf):
    silver = table(spark, sf, "orders")
    chosen = choose_dimension(silver)
    return dimension_scores(silver).select(
        "column", "distinct_values", "n_rows", "groups", (F.col("column") == chosen).alias("chosen")
    )


_CHOOSE_SQL = """
WITH s AS (
  SELECT 0 AS position, 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS distinct_values, count(*) AS n_rows FROM orders
  UNION ALL SELECT 1, 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders),
q AS (SELECT *, distinct_values > 1 AND distinct_values < n_rows AS groups FROM s)
SELECT "column", distinct_values, n_rows, groups,
       "column" = (SELECT "column" FROM q WHERE groups ORDER BY distinct_values, position LIMIT 1) AS chosen FROM q"""


def _gold(name: str, dimension: str, measure: str | None, aggregation: str):
    def run(spark, sf):
        gold = promote_gold(table(spark, sf, name), dimension, measure, aggregation)
        value = gold.columns[-1]
        places = {"SUM": 2, "AVG": 5}.get(aggregation)
        return gold.withColumn(value, F.round(value, places)) if places else gold

    return run


def _medallion_gold(spark, sf):
    customers = table(spark, sf, "customer")
    text = customers.select(*[F.col(c).cast("string").alias(c) for c in customers.columns])
    name = f"{new_schema(spark, 'layers')}.customers"
    return build_layers(text, name, "customers.csv").gold


CHECKS = {
    "dedup_latest": Check(_dedup_latest, _DEDUP_SQL),
    "silver": Check(
        lambda spark, sf: promote_silver(_two_loads(spark, sf)),
        _LOADS_SQL + " SELECT DISTINCT * EXCLUDE (load) FROM loads",
    ),
    "silver_by_key": Check(
        lambda spark, sf: promote_silver(_two_loads(spark, sf), ["o_orderkey"]),
        _LOADS_SQL
        + """ SELECT * EXCLUDE (load) FROM loads
              QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY load DESC) = 1""",
    ),
    "choose_dimension": Check(_choose, _CHOOSE_SQL),
    "gold_count": Check(
        _gold("orders", "o_orderpriority", None, "COUNT"),
        "SELECT o_orderpriority, count(*) AS count_rows FROM orders GROUP BY 1",
    ),
    "gold_countd": Check(
        _gold("orders", "o_orderpriority", "o_custkey", "COUNTD"),
        "SELECT o_orderpriority, count(DISTINCT o_custkey) AS countd_o_custkey FROM orders GROUP BY 1",
    ),
    "gold_sum": Check(
        _gold("lineitem", "l_returnflag", "l_extendedprice", "SUM"),
        "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY 1",
    ),
    "gold_avg": Check(
        _gold("lineitem", "l_suppkey", "l_quantity", "AVG"),
        "SELECT l_suppkey, round(avg(l_quantity), 5) AS avg_l_quantity FROM lineitem GROUP BY 1",
    ),
    "layers_appended": Check(
        _appended,
        _LOADS_SQL
        + """, all_loads AS (
          SELECT o_orderkey, o_orderstatus, o_totalprice, load FROM loads
          UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice * 2, 3 FROM orders WHERE o_orderkey % 5 = 0),
        silver AS (SELECT * FROM all_loads QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY load DESC) = 1)
        SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM silver GROUP BY 1""",
    ),
    "medallion_gold": Check(
        _medallion_gold, "SELECT c_mktsegment, count(*) AS count_rows FROM customer GROUP BY 1"
    ),
}
