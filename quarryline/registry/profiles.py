"""Queries that profile tables (C1-C8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import (
    daily_counts,
    daily_verdict,
    distinct_counts,
    numeric_range,
    profile_namespace,
    profile_table,
    rank_dimensions,
    series_quality,
    value_distribution,
)
from ..session import workspace
from .base import Check, table

# Columns and types of the tables that are profiled below, for writing the SQL side out.
_TABLES = {
    "orders": {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    },
    "customer": {
        "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string",
    },
    "events": {
        "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
        "value": "double", "props": "string",
    },
    "part": {
        "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
        "p_retailprice": "double",
    },
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
        "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "region": {"r_regionkey": "int", "r_name": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}


def _distinct_sql(name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS distinct_values FROM {name}"
        for i, c in enumerate(_TABLES[name])
    )


def _verdict_of_days(name: str, column: str) -> str:
    return f"""
SELECT count(*) AS n_days, min(day) AS first_day, max(day) AS last_day, arg_min(v, day) AS first_count,
       max(v) <> min(v) AS varies
FROM (SELECT date_trunc('day', {column}) AS day, count(*) AS v FROM {name} WHERE {column} IS NOT NULL
      GROUP BY 1)"""


def _shown_values(name: str, column: str) -> str:
    return f"""
SELECT coalesce(CAST({column} AS VARCHAR), 'null') AS value, count(*) AS v,
       row_number() OVER (ORDER BY count(*) DESC, CAST({column} AS VARCHAR) NULLS FIRST) AS place
FROM {name} GROUP BY {column}"""


def _profile_sql(name: str) -> str:
    columns = []
    for i, (column, kind) in enumerate(_TABLES[name].items()):
        numeric, dated = kind in ("bigint", "int", "double"), kind == "timestamp_ntz"
        head = f"SELECT count(*) AS n, count(DISTINCT {column}) AS d FROM {name}"
        if dated:
            probed = f"""SELECT 'date' AS kind, varies, concat(d, ' distinct; ', n_days, ' days ',
                    strftime(first_day, '%Y-%m-%d'), '..', strftime(last_day, '%Y-%m-%d'), ', per-day count ',
                    CASE WHEN varies THEN 'varies'
                         ELSE concat('constant at ', first_count, ': a line would be flat or straight') END) AS note, n, d
                FROM ({head}), ({_verdict_of_days(name, column)})"""
        else:
            spread = f"""SELECT string_agg(value || '=' || v, ', ' ORDER BY place) FILTER (place <= 12)
                    || CASE WHEN count(*) > 12 THEN ' and ' || (count(*) - 12) || ' more' ELSE '' END AS shown,
                    max(v) <> min(v) AS varies FROM ({_shown_values(name, column)})"""
            ranged = f"""SELECT concat('min ', min({column}), ', max ', max({column}), ', avg ',
                    round(avg({column}), 2)) AS shown FROM {name}""" if numeric else "SELECT '' AS shown"
            kind_of = f"""CASE WHEN d BETWEEN 2 AND 15 AND d < n THEN 'dist'
                    WHEN {numeric} AND d > 15 THEN 'range' WHEN d >= n AND n > 1 THEN 'unique' ELSE 'plain' END"""
            unique = "near-unique numeric: a measure" if numeric else "unique per row: a label, not a grouping dimension"
            probed = f"""SELECT kind, CASE kind WHEN 'dist' THEN s.varies ELSE kind = 'range' END AS varies,
                    concat(d, ' distinct', CASE kind
                      WHEN 'dist' THEN concat('; ', s.shown, CASE WHEN s.varies THEN ' (varies)' ELSE ' (all equal: flat)' END)
                      WHEN 'range' THEN concat('; continuous measure, ', r.shown)
                      WHEN 'unique' THEN '; {unique}' ELSE '' END) AS note, n, d
                FROM (SELECT *, {kind_of} AS kind FROM ({head})), ({spread}) s, ({ranged}) r"""
        columns.append(
            f"""SELECT '{name}' AS table_name, {i} AS position, '{column}' AS column_name, '{kind}' AS column_type,
                '{"measure" if numeric else "dimension"}' AS role, n AS n_rows, d AS distinct_values, kind, varies, note
                FROM ({probed})"""
        )
    return " UNION ALL ".join(columns)


def _rank_sql(name: str) -> str:
    spreads = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {name}) AS d, (SELECT count(*) FROM {name}) AS n,
                   round(stddev_pop(v) / avg(v), 4) AS spread, max(v) <> min(v) AS varies
            FROM ({_shown_values(name, c)})"""
        for c, kind in _TABLES[name].items()
        if kind != "timestamp_ntz"
    )
    return f"""
SELECT "column", spread, CAST(row_number() OVER (ORDER BY spread DESC, "column") AS INTEGER) AS place
FROM ({spreads}) WHERE d BETWEEN 2 AND 15 AND d < n AND varies"""


def _daily_counts(spark, sf):
    return daily_counts(table(spark, sf, "lineitem"), ["l_shipdate"]).unionByName(
        daily_counts(table(spark, sf, "events"), ["ts"])
    )


def _daily_sql(name: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", day, count_rows FROM (
        SELECT date_trunc('day', {column})::TIMESTAMP AS day, count(*) AS count_rows FROM {name}
        WHERE {column} IS NOT NULL GROUP BY 1)"""


_SHOWN = ("l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_partkey")
_RANGED = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_orderkey")


def _series_quality(spark, sf):
    """Order counts per customer and day, each customer a series."""
    per_day = table(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("n_orders"))
    return series_quality(per_day, "o_orderdate", "n_orders", "o_custkey")


_QUALITY_SQL = """
WITH p AS (SELECT o_custkey, o_orderdate, count(*) AS y FROM orders GROUP BY 1, 2),
s AS (SELECT o_custkey, y, y - lag(y) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS step FROM p)
SELECT o_custkey, count(*) AS n_points,
       CASE WHEN count(*) = 1 THEN 'single point' WHEN max(y) = min(y) THEN 'flat'
            WHEN count(*) > 2 AND max(step) = min(step) THEN 'straight line' ELSE 'varies' END AS quality
FROM s GROUP BY 1"""


def _type_quality(spark, sf):
    """The value of events so far, by type: as growth to date, then as counts of single events."""
    events = table(spark, sf, "events").select("event_type", "event_id", F.lit(1.0).alias("one"))
    flat = series_quality(events, "event_id", "one", "event_type").withColumn("series", F.lit("one per event"))
    even = events.select(F.lit("all").alias("event_type"), "event_id", (F.col("event_id") * 3).alias("y"))
    straight = series_quality(even, "event_id", "y", "event_type").withColumn("series", F.lit("three per id"))
    kept = series_quality(even, "event_id", "y", "event_type", cumulative=True).withColumn(
        "series", F.lit("three per id, asked for")
    )
    return flat.unionByName(straight).unionByName(kept)


_TYPE_QUALITY_SQL = """
SELECT event_type, count(*) AS n_points, 'flat' AS quality, 'one per event' AS series FROM events GROUP BY 1
UNION ALL
SELECT 'all', count(*), CASE WHEN max(step) = min(step) THEN 'straight line' ELSE 'varies' END, 'three per id'
FROM (SELECT 3 * (event_id - lag(event_id) OVER (ORDER BY event_id)) AS step FROM events)
UNION ALL
SELECT 'all', count(*), 'varies', 'three per id, asked for' FROM events"""

CHECKS = {
    "distinct_counts": Check(lambda spark, sf: distinct_counts(table(spark, sf, "lineitem")), _distinct_sql("lineitem")),
    "daily_counts": Check(
        _daily_counts, _daily_sql("lineitem", "l_shipdate") + " UNION ALL " + _daily_sql("events", "ts")
    ),
    "daily_verdict": Check(
        lambda spark, sf: daily_verdict(table(spark, sf, "orders"), ["o_orderdate"]),
        f"""SELECT 'o_orderdate' AS "column", n_days, first_day::TIMESTAMP AS first_day, last_day::TIMESTAMP AS last_day,
                   first_count, varies FROM ({_verdict_of_days("orders", "o_orderdate")})""",
    ),
    "value_distribution": Check(
        lambda spark, sf: value_distribution(table(spark, sf, "lineitem"), list(_SHOWN)),
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", value, v AS count_rows, CAST(place AS INTEGER) AS place
                FROM ({_shown_values("lineitem", c)}) WHERE place <= 12"""
            for c in _SHOWN
        ),
    ),
    "numeric_range": Check(
        lambda spark, sf: numeric_range(table(spark, sf, "lineitem"), list(_RANGED)).drop("shown"),
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value,
                       round(avg({c}), 2) AS avg_value FROM lineitem"""
            for c in _RANGED
        ),
    ),
    "profile_table": Check(
        lambda spark, sf: profile_table(table(spark, sf, "orders"), "orders"), _profile_sql("orders")
    ),
    "profile_namespace": Check(
        lambda spark, sf: profile_namespace({name: table(spark, sf, name) for name in _TABLES}, folder=workspace(spark, "profiles")),
        " UNION ALL ".join(_profile_sql(name) for name in _TABLES),
    ),
    "rank_dimensions": Check(
        lambda spark, sf: rank_dimensions(table(spark, sf, "lineitem")), _rank_sql("lineitem")
    ),
    "series_quality": Check(_series_quality, _QUALITY_SQL),
    "series_quality_long": Check(_type_quality, _TYPE_QUALITY_SQL),
}
