import datetime as dt

import pytest

from quarryline.operators.charts import ShelfField, category, crosstab, crosstab_sparse, geo_pairs, scatter_points, series, share_of_total, shelf_query
from quarryline.plans.view import ChartSpec, Shelves, snapshot_view, title_of, view_query


@pytest.fixture(scope="module")
def visits(spark):
    data = [
        ("AT", "web", 1, 10.0, "2026-01-01 09:00:00"),
        ("AT", "app", 2, None, "2026-01-01 21:00:00"),
        ("DE", "web", 2, 30.0, "2026-01-15 00:00:00"),
        ("DE", "web", 3, 20.0, "2026-02-01 00:00:00"),
        (None, "app", 3, 40.0, None),
    ]
    df = spark.createDataFrame(data, "country string, channel string, user int, spent double, at string")
    return df.selectExpr("country", "channel", "user", "spent", "cast(at as timestamp_ntz) as at")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def day(month, date):
    return dt.datetime(2026, month, date)


def test_category(visits):
    assert as_set(category(visits, "country", "spent")) == {("AT", 10.0), ("DE", 50.0), (None, 40.0)}
    assert as_set(category(visits, "country", "spent", "count")) == {("AT", 1), ("DE", 2), (None, 1)}
    assert category(visits, "country", "spent", "AVG", "channel").columns == ["country", "channel", "avg_spent"]


def test_series(visits):
    assert as_set(series(visits, "at")) == {(day(1, 1), 2), (day(1, 15), 1), (day(2, 1), 1)}
    assert as_set(series(visits, "at", "spent", "SUM", "month")) == {(day(1, 1), 40.0), (day(2, 1), 20.0)}
    assert as_set(series(visits, "at", "user", "COUNTD", "year")) == {(day(1, 1), 3)}
    assert as_set(series(visits, "at", "user", "MIN", "week")) == {(day(1, 1), 1), (day(1, 15), 2), (day(2, 1), 3)}
    assert as_set(series(visits, "at", cumulative=True)) == {(day(1, 1), 2), (day(1, 15), 3), (day(2, 1), 4)}
    with pytest.raises(ValueError):
        series(visits, "at", "spent", "MEDIAN")
    with pytest.raises(ValueError):
        series(visits, "at", "spent", "AVG", cumulative=True)


def test_share(visits):
    shares = {r.country: (r.share, r.label) for r in share_of_total(visits, "country", "spent").collect()}
    assert shares == {"AT": (10.0, "10.0%"), "DE": (50.0, "50.0%"), None: (40.0, "40.0%")}
    # Distinct users overlap, so the shares of COUNTD add up to more than the whole.
    distinct = {r.country: r.share for r in share_of_total(visits, "country", "user", "COUNTD").collect()}
    assert distinct == {"AT": 66.7, "DE": 66.7, None: 33.3}


def test_scatter(visits):
    assert as_set(scatter_points(visits, "channel", "spent", "user")) == {("web", 60.0, 6), ("app", 40.0, 5)}
    assert as_set(scatter_points(visits, None, "user")) == {(11, 11)}


def test_scatter_keeps_its_colour(visits):
    points = scatter_points(visits, "channel", "spent", "user", color="country")
    assert points.columns == ["channel", "country", "x", "y"]


def test_share_of_a_total_of_zero(rows):
    found = share_of_total(rows([("a", 5), ("b", -5)], "g string, v int"), "g", "v").collect()
    assert [r.share for r in found] == [None, None]


def test_crosstab_refuses_to_lose_values(rows):
    cells = rows([("r", "A", 1), ("r", "B", 2), ("r", None, 3)], "g string, c string, v int")
    assert set(crosstab(cells, "g", "c", "v").columns) == {"g", "A", "B", "null"}
    with pytest.raises(Exception, match="no column for"):
        crosstab(cells, "g", "c", "v", values=["A"]).collect()


def test_shelves(visits):
    layout = [ShelfField("at", "tmonth"), ShelfField("channel"), ShelfField("spent", "sum"), ShelfField("user", "cntd")]
    found = shelf_query(visits.filter("at is not null"), layout)
    assert found.columns == ["tmonth_at", "channel", "sum_spent", "cntd_user"]
    assert as_set(found) == {(day(1, 1), "web", 40.0, 2), (day(1, 1), "app", None, 1), (day(2, 1), "web", 20.0, 1)}
    assert as_set(shelf_query(visits, [ShelfField("spent", "sum"), ShelfField("spent", "cnt")])) == {(100.0, 4)}
    assert as_set(shelf_query(visits, [ShelfField("at", "year")])) == {(2026,), (None,)}
    with pytest.raises(ValueError, match="median"):
        shelf_query(visits, [ShelfField("spent", "median")])


def test_pairs_and_crosstab(visits):
    assert as_set(geo_pairs(visits, "country", "channel")) == {("AT", "web"), ("AT", "app"), ("DE", "web"), (None, "app")}
    assert as_set(crosstab(visits, "country", "channel", "spent")) == {("AT", None, 10.0), ("DE", None, 50.0), (None, 40.0, None)}


def test_views(visits):
    def view(**spec):
        return view_query(visits, ChartSpec(table="site_visits", **spec))

    assert as_set(view(chart_type="map", geo_field="country", measure="spent")) == {("AT", 10.0), ("DE", 50.0), (None, 40.0)}
    assert view(chart_type="donut", dimension="channel", measure="spent").columns == ["channel", "sum_spent", "share", "label"]
    line = view(chart_type="line", dimension="at", measure="user")
    assert line.columns == ["at", "Site Visits"]
    assert as_set(line) == {(day(1, 1), 2), (day(1, 15), 3), (day(2, 1), 4)}
    bars = view(chart_type="bar", dimension="at", measure="user", date_granularity="month")
    assert as_set(bars) == {(day(1, 1), 3), (day(2, 1), 1)}
    averages = view(chart_type="area", dimension="at", measure="spent", aggregation="AVG", date_granularity="month")
    assert as_set(averages) == {(day(1, 1), 20.0), (day(2, 1), 20.0)}
    shelves = Shelves(mark="Line", cols=(ShelfField("at", "tday"),), rows=(ShelfField("user", "cnt"),))
    assert as_set(view(chart_type="other", shelves=shelves)) == {(day(1, 1), 2), (day(1, 15), 3), (day(2, 1), 4)}
    square = Shelves(mark="Square", rows=(ShelfField("channel"),), encodings=(ShelfField("spent", "avg"),))
    assert as_set(view(chart_type="table", shelves=square)) == {("web", 20.0), ("app", 40.0)}
    assert view(chart_type="scatter", dimension="channel", measure="spent").columns == ["channel", "x", "y"]


@pytest.mark.parametrize(
    "spec, message",
    [
        ({"dimension": "city", "measure": "spent"}, "city"),
        ({"dimension": "country", "measure": "spent", "color_field": "hue"}, "hue"),
        ({"shelves": Shelves(rows=(ShelfField("nowhere"),))}, "nowhere"),
        ({"shelves": Shelves(mark="Blob", rows=(ShelfField("country"),))}, "Blob"),
        ({"shelves": Shelves(rows=(ShelfField("spent", "median"),))}, "median"),
    ],
)
def test_bad_specs(visits, spec, message):
    with pytest.raises(ValueError, match=message):
        view_query(visits, ChartSpec(table="visits", **spec))


def test_titles(visits):
    spec = ChartSpec(table="visits", chart_type="line", dimension="at", title="Visits")
    assert title_of(visits, spec) == "Cumulative Visits"
    assert title_of(visits, ChartSpec(table="visits", chart_type="line", dimension="at", title="Running visits")) == "Running visits"
    assert title_of(visits, ChartSpec(table="visits", chart_type="bar", dimension="at", title="Visits")) == "Visits"


def test_columns_and_filters_reach_the_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = series(lines, "l_shipdate", cumulative=True)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)]" in plan and "ReadSchema: struct<l_shipdate:timestamp_ntz>" in plan
    plan = category(lines, "l_returnflag", "l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_snapshots(visits, tmp_path):
    spec = ChartSpec(table="visits", chart_type="bar", dimension="at", aggregation="COUNT")

    def written(folder):
        return [line for f in sorted((tmp_path / folder).glob("*.csv")) for line in f.read_text().splitlines()]

    snapshot_view(visits, spec, str(tmp_path / "all"))
    days = ["2026-01-01 00:00:00,2", "2026-01-15 00:00:00,1", "2026-02-01 00:00:00,1"]
    assert [line for line in written("all") if line != "at,Visits"] == days
    snapshot_view(visits, spec, str(tmp_path / "first"), limit=2)
    assert [line for line in written("first") if line != "at,Visits"] == days[:2]
    with pytest.raises(ValueError, match="no dated rows"):
        snapshot_view(visits.filter("at is null"), spec, str(tmp_path / "none"))


def test_a_gantt_of_dates_keeps_its_shelves(visits):
    layout = Shelves(mark="GanttBar", cols=(ShelfField("at", "tday"),), rows=(ShelfField("channel"),))
    found = view_query(visits, ChartSpec(table="visits", shelves=layout))
    assert found.columns == ["tday_at", "channel"] and found.count() == 5


def test_a_sparse_crosstab_has_the_cells_of_the_groups(spark):
    """More column values than a pivot allows, nulls on both sides."""
    df = spark.range(40_000).selectExpr(
        "if(id % 7 = 0, null, id % 5) AS place", "if(id % 11 = 0, null, id % 12000) AS item", "cast(id % 13 AS int) AS qty"
    )
    found = crosstab_sparse(df, "place", "item", "qty", width=5000)
    assert found.selectExpr("max(size(cells)) AS n").first().n <= 5000
    cells = {(r.place, r.column): (r.part, r.column_no, r.value) for r in found.selectExpr("place", "part", "inline(cells)").collect()}
    grouped = df.groupBy("place", "item").sum("qty").collect()
    items = {v: i for i, v in enumerate([*sorted({r.item for r in grouped} - {None}), None])}
    assert cells == {(r.place, r.item): (items[r.item] // 5000, items[r.item], r["sum(qty)"]) for r in grouped}
    for r in found.collect():
        assert [c.column_no for c in r.cells] == sorted(c.column_no for c in r.cells)
    with pytest.raises(Exception, match="pivot"):
        crosstab(df, "place", "item", "qty").collect()
    assert crosstab_sparse(df.limit(0), "place", "item", "qty").count() == 0
