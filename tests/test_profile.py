import pytest
from pyspark.sql import functions as F

from quarryline.operators.medallion import choose_dimension
from quarryline.operators.profile import (
    EXACT_VALUES,
    _probe_findings,
    STATE_ERROR,
    column_kinds,
    column_states,
    daily_counts,
    daily_verdict,
    distinct_counts,
    distribution_verdict,
    list_columns,
    profile_namespace,
    profile_table,
    rank_dimensions,
    series_quality,
    value_distribution,
)


@pytest.fixture(scope="module")
def sales(spark):
    return spark.range(120).selectExpr(
        "id",
        "concat('c', id % 4) as city",
        "if(id < 100, 'paid', 'open') as state",
        "'same' as constant",
        "cast(id % 30 as double) as amount",
        "concat('name ', id) as name",
        "timestamp_ntz'2026-01-01 10:00:00' + make_interval(0, 0, 0, cast(id % 10 as int)) as at",
        "if(id % 2 = 0, null, 'odd') as parity",
    )


def test_profile(sales):
    found = {r.column_name: r for r in profile_table(sales, "sales").collect()}
    assert len(found) == 8
    assert {c: (r.kind, r.varies, r.role) for c, r in found.items()} == {
        "id": ("range", True, "measure"),
        "city": ("dist", False, "dimension"),
        "state": ("dist", True, "dimension"),
        "constant": ("plain", False, "dimension"),
        "amount": ("range", True, "measure"),
        "name": ("unique", False, "dimension"),
        "at": ("date", False, "dimension"),
        "parity": ("plain", False, "dimension"),
    }
    assert found["state"].note == "2 distinct; paid=100, open=20 (varies)"
    assert found["city"].note == "4 distinct; c0=30, c1=30, c2=30, c3=30 (all equal: flat)"
    assert found["at"].note.startswith("10 distinct; 10 days 2026-01-01..2026-01-10, per-day count constant at 12")
    assert found["amount"].note == "30 distinct; continuous measure, min 0.0, max 29.0, avg 14.5"
    assert found["name"].note == "120 distinct; unique per row: a label, not a grouping dimension"
    assert found["constant"].note == "1 distinct"


def test_profile_of_nothing(sales):
    empty = sales.limit(0)
    assert profile_table(empty, "empty").count() == 0
    both = profile_namespace({"sales": sales, "empty": empty})
    assert both.select("table_name").distinct().count() == 1 and both.count() == 8


def test_few_unique_values_are_not_a_distribution(rows):
    df = rows([("a", 1), ("b", 2)], "t string, n int")
    assert [k.kind for k in column_kinds(df)] == ["unique", "unique"]


def test_distinct_counts_equal_sparks(spark, sales):
    data = [(0.0, "a", True, 0), (-0.0, "a", None, 1), (float("nan"), "", False, None), (None, None, True, 1)]
    odd = spark.createDataFrame(data, "d double, s string, b boolean, n int").withColumn(
        "t", F.timestamp_seconds(F.lit(1761433200) + 3600 * F.col("n"))
    )
    nested = odd.select(F.array("s", "s").alias("a"), F.struct("b", "n").alias("r"), F.encode("s", "utf-8").alias("raw"))
    for table in (sales, odd, odd.limit(0), nested):
        plain = table.agg(*[F.count_distinct(c) for c in table.columns]).first()
        assert [r.distinct_values for r in distinct_counts(table).orderBy("position").collect()] == list(plain)


def test_verdicts_see_all_values_and_days(spark):
    rows = spark.range(123).selectExpr("if(id < 120, id % 12, id) as v")  # 12 values of 10 rows, 3 of one
    found = distribution_verdict(rows, ["v"]).first()
    assert found.varies and found.spread > 0 and found.shown.endswith("9=10 and 3 more")
    assert [r.column for r in rank_dimensions(rows.selectExpr("cast(v as string) as v")).collect()] == ["v"]
    days = spark.range(100).selectExpr("date_add(date'2026-01-01', cast(id as int)) as d")
    verdict = daily_verdict(days.union(days.where("d = date'2026-04-10'")), ["d"]).first()
    assert (verdict.n_days, verdict.varies, str(verdict.last_day)[:10]) == (100, True, "2026-04-10")


def test_the_two_zeros_are_one_value(rows):
    found = value_distribution(rows([(0.0,), (-0.0,), (1.0,)], "v double"), ["v"]).collect()
    assert {(r.value, r.count_rows) for r in found} == {("0.0", 2), ("1.0", 1)}


def test_approximate_counts_are_close(sales):
    exact = {r.column: r.distinct_values for r in distinct_counts(sales).collect()}
    close = {r.column: r.distinct_values for r in distinct_counts(sales, approx=True).collect()}
    assert exact.keys() == close.keys()
    assert all(abs(close[c] - exact[c]) <= 0.1 * exact[c] + 1 for c in exact)


def test_rank(sales):
    assert [tuple(r)[::2] for r in rank_dimensions(sales).collect()] == [("state", 1)]
    assert rank_dimensions(sales.select("name", "constant")).count() == 0


def test_distribution_shows_null_and_the_top_only(spark):
    df = spark.range(100).selectExpr("if(id < 50, null, id) as v")
    found = value_distribution(df, ["v"], top=12).orderBy("place").collect()
    assert len(found) == 12 and (found[0].value, found[0].count_rows) == ("null", 50)


def test_a_listing_of_days_can_be_cut(spark):
    df = spark.range(100).selectExpr("date_add(date'2026-01-01', cast(id as int)) as d")
    days = daily_counts(df.union(df.filter("d > date'2026-03-15'")), ["d"], limit=60)
    assert days.count() == 60 and days.filter("count_rows <> 1").count() == 0


def test_list_columns(rows):
    tables = {"b": rows([], "x int"), "a": rows([], "y string, z double")}
    assert list_columns(tables) == "a(y string, z double)\nb(x int)"


SERIES = {
    "single point": [(1, 5.0)],
    "flat": [(i, 7.0) for i in range(5)],
    "straight line": [(i, 2.0 * i + 2) for i in range(5)],
    "varies": [(1, 3.0), (2, 1.0), (3, 4.0), (4, 1.0), (5, 5.0)],
    "empty": [(1, None), (None, 4.0)],
}


def test_series_quality(rows):
    data = [(kind, x, y) for kind, points in SERIES.items() for x, y in points]
    found = series_quality(rows(data, "g string, x int, y double"), "x", "y", "g")
    assert {r.g: r.quality for r in found.collect()} == {kind: kind for kind in SERIES}
    kept = series_quality(rows(data, "g string, x int, y double"), "x", "y", "g", cumulative=True)
    assert {r.g: r.quality for r in kept.collect()}["straight line"] == "varies"


def test_two_points_are_no_line(rows):
    found = series_quality(rows([("a", 1, 1.0), ("a", 2, 2.0)], "g string, x int, y double"), "x", "y", "g")
    assert found.first().quality == "varies"


@pytest.mark.parametrize("bend, expected", [(None, "straight line"), (0, "varies"), (5000, "varies"), (19_999, "varies")])
def test_a_long_series_is_judged_whole(spark, bend, expected):
    """One series is cut into stretches; a bend anywhere, also between two stretches, is found."""
    df = spark.range(20_000).withColumn("y", F.col("id") * 2 + F.when(F.col("id") == bend, 1).otherwise(0))
    found = series_quality(df.selectExpr("'all' as g", "id as x", "y"), "x", "y", "g").collect()
    assert [(r.n_points, r.quality) for r in found] == [(20_000, expected)]


def test_every_place_of_a_bend(spark):
    df = spark.range(40).selectExpr("id as bend", "explode(sequence(0, 39)) as x")
    bent = df.selectExpr("bend as g", "x", "x + if(x = bend, 0.5, 0) as y")
    found = series_quality(bent, "x", "y", "g")
    assert {r.quality for r in found.collect()} == {"varies"} and found.count() == 40


def test_states_are_exact_up_to_their_bound_and_over_it_beyond(spark):
    df = spark.range(0, 50_000, 1, 8).select(
        "id",
        (F.col("id") % EXACT_VALUES).alias("full"),
        (F.col("id") % 15).cast("string").alias("few"),
        F.when(F.col("id") % 2 == 0, F.lit("")).alias("empty"),
        (F.col("id") % 7 * F.lit(-0.0)).alias("zeros"),
        F.lit(None).cast("int").alias("none"),
        F.struct((F.col("id") % 3).alias("a")).alias("nested"),
        F.create_map(F.lit("k"), F.col("id") % 5).alias("mapped"),
        F.unhex(F.hex(F.col("id") % 6)).alias("raw"),
    )
    found = {r.column: (r.n_rows, r.n_present, r.about) for r in column_states(df).collect()}
    n, present, about = found.pop("id")
    assert (n, present) == (50_000, 50_000) and abs(about - 50_000) < 50_000 * STATE_ERROR
    assert {c: f[2] for c, f in found.items()} == {
        "full": EXACT_VALUES, "few": 15, "empty": 1, "zeros": 1, "none": 0, "nested": 3, "mapped": 5, "raw": 6
    }
    assert found["empty"][1] == 25_000 and found["none"][1] == 0
    assert [tuple(r)[2:] for r in column_states(df.limit(0)).collect()] == [(0, 0, 0)] * 9


def test_kinds_by_states_equal_kinds_by_counts(spark):
    df = spark.range(0, 20_000, 1, 4).select(
        "id",
        F.col("id").cast("string").alias("label"),
        F.when(F.col("id") > 0, F.col("id").cast("string")).alias("label_with_null"),
        F.when(F.col("id") > 0, F.col("id")).otherwise(1).cast("string").alias("one_twice"),
        (F.col("id") % 9000).cast("string").alias("many"),
        (F.col("id") % 16).cast("string").alias("sixteen"),
        (F.col("id") % 15).cast("string").alias("fifteen"),
        F.lit("x").alias("same"),
    )
    kinds = {k.name: (k.kind, k.distinct) for k in column_kinds(df)}
    assert kinds == {
        "id": ("range", 20_000), "label": ("unique", 20_000), "label_with_null": ("plain", 19_999), "one_twice": ("plain", 19_999),
        "many": ("plain", 9000), "sixteen": ("plain", 16), "fifteen": ("dist", 15), "same": ("plain", 1),
    }
    rough = {k.name: k.kind for k in column_kinds(df, approx=True)}
    assert {c for c in kinds if kinds[c][0] != rough[c]} <= {"one_twice"}  # one repeat in 20,000 is beyond an estimate
    assert choose_dimension(df) == "fifteen" and choose_dimension(df.select("label", "one_twice", "many")) == "many"
    assert choose_dimension(df.select("label", "one_twice")) == "one_twice"
    assert choose_dimension(df.select("label", "same")) == "label"


def test_states_do_not_exchange_values(spark):
    df = spark.range(0, 1000, 1, 4).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    plan = column_states(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("Exchange SinglePartition") == 1


def test_probes_of_all_kinds_are_one_scan(spark, tmp_path):
    df = spark.range(300).selectExpr(
        "id", "cast(id % 3 AS string) AS few", "cast(id / 7 AS float) AS ratio", "cast(id AS decimal(12,3)) AS price",
        "date_add(date'2026-01-01', cast(id % 40 AS int)) AS day", "if(id % 2 = 0, 0.0D, -0.0D) AS zero", "id % 2 = 1 AS odd",
    )
    df.write.parquet(str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t"))
    plain = [k for k in column_kinds(kept) if k.name != "price"]
    plan = _probe_findings(kept, plain, 12)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    found = {r.column_name: r.note for r in profile_table(kept, "t").collect()}
    assert found == {
        "id": "300 distinct; continuous measure, min 0, max 299, avg 149.5",
        "few": "3 distinct; 0=100, 1=100, 2=100 (all equal: flat)",
        "ratio": "300 distinct; continuous measure, min 0.0, max 42.714287, avg 21.36",
        "price": "300 distinct; continuous measure, min 0.000, max 299.000, avg 149.50",
        "day": "40 distinct; 40 days 2026-01-01..2026-02-09, per-day count varies",
        "zero": "1 distinct",
        "odd": "2 distinct; false=150, true=150 (all equal: flat)",
    }


def test_profiles_written_one_by_one_are_the_same(spark, tmp_path):
    tables = {"a": spark.range(20).selectExpr("id", "id % 2 AS odd"), "b": spark.range(3).selectExpr("'x' AS same"), "c": spark.range(0)}
    together, apart = profile_namespace(tables), profile_namespace(tables, folder=str(tmp_path / "profiles"))
    assert together.columns == apart.columns and sorted(together.collect()) == sorted(apart.collect())
