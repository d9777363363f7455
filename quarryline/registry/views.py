"""Queries for chart datasets (D1-D10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.charts import ShelfField, category, crosstab, crosstab_sparse, geo_pairs, scatter_points, series, share_of_total, shelf_query
from ..operators.infer import cast_typed
from ..plans.view import ChartSpec, Shelves, snapshot_view, view_query
from ..session import workspace
from ..sources.csv import scan_csv
from .base import Check, table


def _rounded(df: DataFrame, *columns: str, places: int = 2) -> DataFrame:
    """Sums of doubles depend on the order of adding in their last digits; averages keep five places."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def _category(spark, sf):
    lines = table(spark, sf, "lineitem")
    return _rounded(category(lines, "l_partkey", "l_extendedprice"), "sum_l_extendedprice")


def _color(spark, sf):
    orders = table(spark, sf, "orders")
    return _rounded(category(orders, "o_orderpriority", "o_totalprice", "AVG", "o_orderstatus"), "avg_o_totalprice", places=5)


def _shares(spark, sf):
    lines = table(spark, sf, "lineitem")
    parts = []
    for measure, aggregation in (("l_extendedprice", "SUM"), ("l_orderkey", "COUNT"), ("l_orderkey", "COUNTD")):
        shares = share_of_total(lines, "l_returnflag", measure, aggregation)
        parts.append(shares.select("l_returnflag", F.lit(aggregation).alias("aggregation"), "share", "label"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _share_sql(aggregate: str, name: str) -> str:
    return f"""
SELECT l_returnflag, '{name}' AS aggregation, round({aggregate} / (SELECT {aggregate} FROM lineitem) * 100, 1) AS share,
       CAST(round({aggregate} / (SELECT {aggregate} FROM lineitem) * 100, 1) AS VARCHAR) || '%' AS label
FROM lineitem GROUP BY 1"""


def _scatter(spark, sf):
    return _rounded(scatter_points(table(spark, sf, "part"), "p_brand", "p_retailprice", "p_size", "AVG"), "x", "y", places=5)


def _treemap(spark, sf):
    tree = [ShelfField("p_retailprice", "sum"), ShelfField("p_brand"), ShelfField("p_type"), ShelfField("p_partkey", "cntd")]
    return _rounded(shelf_query(table(spark, sf, "part"), tree), "sum_p_retailprice")


def _gantt(spark, sf):
    layout = [
        ShelfField("o_orderdate", "tmonth"), ShelfField("o_orderdate", "year"), ShelfField("o_orderpriority"),
        ShelfField("o_totalprice", "sum"), ShelfField("o_orderkey", "cnt"),
    ]
    return _rounded(shelf_query(table(spark, sf, "orders"), layout), "sum_o_totalprice")


def _geo(spark, sf):
    places = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return geo_pairs(places, "n_name", "c_mktsegment")


def _crosstab_sparse(spark, sf):
    """Quantities by line status and part, the cells of each row in parts of 500 columns."""
    table_of_cells = crosstab_sparse(table(spark, sf, "lineitem"), "l_linestatus", "l_partkey", "l_quantity", width=500)
    return table_of_cells.select("l_linestatus", "part", F.inline("cells")).withColumnRenamed("column", "l_partkey")


def _crosstab(spark, sf):
    cells = crosstab(table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity")
    return _rounded(cells, "A", "N", "R")


def _map_as_bar(spark, sf):
    spec = ChartSpec(table="customer", chart_type="map", geo_field="c_nationkey", measure="c_acctbal", aggregation="AVG")
    return _rounded(view_query(table(spark, sf, "customer"), spec), "avg_c_acctbal", places=5)


def _line(spark, sf):
    spec = ChartSpec(
        table="order_lines", chart_type="line", dimension="l_shipdate", measure="l_quantity", aggregation="SUM",
        date_granularity="month",
    )
    return _rounded(view_query(table(spark, sf, "lineitem"), spec), "l_quantity")


def _donut(spark, sf):
    spec = ChartSpec(table="orders", chart_type="donut", dimension="o_orderpriority", measure="o_totalprice", aggregation="AVG")
    return view_query(table(spark, sf, "orders"), spec).select("o_orderpriority", "share", "label")


def _snapshot(spark, sf):
    """A line's dataset written as CSV, and read back as any other file."""
    spec = ChartSpec(
        table="lines", chart_type="area", dimension="l_shipdate", measure="l_orderkey", aggregation="COUNT",
        date_granularity="month",
    )
    path = workspace(spark, "snapshot")
    snapshot_view(table(spark, sf, "lineitem"), spec, path)
    text = scan_csv(spark, path)
    typed = cast_typed(text, {"l_shipdate": "DATETIME", "Lines": "BIGINT"})
    return typed.withColumnRenamed("Lines", "n_lines")


def _shelves(spark, sf):
    spec = ChartSpec(
        table="orders",
        shelves=Shelves(
            mark="Square",
            rows=(ShelfField("o_orderpriority"),),
            cols=(ShelfField("o_orderstatus"),),
            encodings=(ShelfField("o_totalprice", "avg"),),
        ),
        chart_type="table",
    )
    return _rounded(view_query(table(spark, sf, "orders"), spec), "avg_o_totalprice", places=5)


CHECKS = {
    "category_sum": Check(
        _category,
        "SELECT l_partkey, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY 1",
    ),
    "color_breakdown": Check(
        _color,
        "SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 5) AS avg_o_totalprice FROM orders GROUP BY 1, 2",
    ),
    "series_day_count": Check(
        lambda spark, sf: series(table(spark, sf, "events"), "ts", value="n_events"),
        "SELECT date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS n_events FROM events GROUP BY 1",
    ),
    "series_month_avg": Check(
        lambda spark, sf: _rounded(series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "AVG", "month"), "value", places=5),
        """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, round(avg(o_totalprice), 5) AS value
           FROM orders GROUP BY 1""",
    ),
    "series_year_countd": Check(
        lambda spark, sf: series(table(spark, sf, "orders"), "o_orderdate", "o_custkey", "COUNTD", "year"),
        """SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS o_orderdate, count(DISTINCT o_custkey) AS value
           FROM orders GROUP BY 1""",
    ),
    "series_month_max": Check(
        lambda spark, sf: series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "MAX", "month"),
        """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, max(o_totalprice) AS value
           FROM orders GROUP BY 1""",
    ),
    "series_cumulative": Check(
        lambda spark, sf: _rounded(
            series(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", "SUM", cumulative=True), "value"
        ),
        """SELECT l_shipdate, round(sum(v) OVER (ORDER BY l_shipdate), 2) AS value
           FROM (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS l_shipdate, sum(l_extendedprice) AS v
                 FROM lineitem GROUP BY 1)""",
    ),
    "share_of_total": Check(
        _shares,
        " UNION ALL ".join(
            [
                _share_sql("sum(l_extendedprice)", "SUM"),
                _share_sql("count(l_orderkey)", "COUNT"),
                _share_sql("count(DISTINCT l_orderkey)", "COUNTD"),
            ]
        ),
    ),
    "scatter_points": Check(
        _scatter,
        "SELECT p_brand, round(avg(p_retailprice), 5) AS x, round(avg(p_size), 5) AS y FROM part GROUP BY 1",
    ),
    "shelf_treemap": Check(
        _treemap,
        """SELECT p_brand, p_type, round(sum(p_retailprice), 2) AS sum_p_retailprice,
                  count(DISTINCT p_partkey) AS cntd_p_partkey FROM part GROUP BY 1, 2""",
    ),
    "shelf_gantt": Check(
        _gantt,
        """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS tmonth_o_orderdate,
                  CAST(year(o_orderdate) AS INTEGER) AS year_o_orderdate, o_orderpriority,
                  round(sum(o_totalprice), 2) AS sum_o_totalprice, count(o_orderkey) AS cnt_o_orderkey
           FROM orders GROUP BY 1, 2, 3""",
    ),
    "geo_pairs": Check(
        _geo, "SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey"
    ),
    "crosstab_sparse": Check(
        _crosstab_sparse,
        """SELECT l_linestatus, (n - 1) // 500 AS part, n - 1 AS column_no, l_partkey, value
           FROM (SELECT l_linestatus, l_partkey, sum(l_quantity) AS value, dense_rank() OVER (ORDER BY l_partkey) AS n
                 FROM lineitem GROUP BY 1, 2)""",
    ),
    "crosstab": Check(
        _crosstab,
        """SELECT l_linenumber, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS "A",
                  round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS "N",
                  round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS "R" FROM lineitem GROUP BY 1""",
    ),
    "view_query_bar": Check(
        _map_as_bar, "SELECT c_nationkey, round(avg(c_acctbal), 5) AS avg_c_acctbal FROM customer GROUP BY 1"
    ),
    "view_query_line": Check(
        _line,
        """SELECT l_shipdate, round(sum(v) OVER (ORDER BY l_shipdate), 2) AS l_quantity
           FROM (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS l_shipdate, sum(l_quantity) AS v
                 FROM lineitem GROUP BY 1)""",
    ),
    "view_query_pie": Check(
        _donut,
        """SELECT o_orderpriority, round(avg(o_totalprice) / (SELECT avg(o_totalprice) FROM orders) * 100, 1) AS share,
                  CAST(round(avg(o_totalprice) / (SELECT avg(o_totalprice) FROM orders) * 100, 1) AS VARCHAR) || '%' AS label
           FROM orders GROUP BY 1""",
    ),
    "snapshot_view": Check(
        _snapshot,
        """SELECT l_shipdate, CAST(sum(v) OVER (ORDER BY l_shipdate) AS BIGINT) AS n_lines
           FROM (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS l_shipdate, count(*) AS v
                 FROM lineitem GROUP BY 1)""",
    ),
    "view_query_shelves": Check(
        _shelves,
        """SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 5) AS avg_o_totalprice
           FROM orders GROUP BY 1, 2""",
    ),
}
