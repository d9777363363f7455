import pytest
from pyspark.sql import functions as F

from quarryline.operators.rows import delete_rows, update_rows
from quarryline.plans.build import build_layers
from quarryline.sources.tables import load_bronze, load_flat, rewrite_table, table_columns

SIGNUPS = [("US",)] * 6 + [("GB",)] * 3 + [("AT",)]


def signups(rows):
    data = [(str(i), country, f"Person {i}") for i, (country,) in enumerate(SIGNUPS)]
    return rows(data, "signup_id string, country_code string, full_name string")


def test_build_layers(spark, rows, schema):
    layers = build_layers(signups(rows), f"{schema}.signups", "signups.csv")
    assert layers.bronze.count() == 10 and layers.silver.count() == 10
    assert layers.dimension == "country_code"
    assert {tuple(r) for r in layers.gold.collect()} == {("US", 6), ("GB", 3), ("AT", 1)}
    assert layers.bronze.columns[-2:] == ["_ingested_at", "_source"]
    assert layers.silver.columns == ["signup_id", "country_code", "full_name"]
    assert dict(layers.silver.dtypes)["signup_id"] == "int"


def test_loading_twice_adds_nothing_to_silver(rows, schema):
    for mode in ("append", "append"):
        layers = build_layers(signups(rows), f"{schema}.signups", "signups.csv", mode=mode)
    assert layers.bronze.count() == 20 and layers.silver.count() == 10
    assert {tuple(r) for r in layers.gold.collect()} == {("US", 6), ("GB", 3), ("AT", 1)}


def test_bronze_append_goes_by_name(rows, schema):
    load_bronze(rows([(1, "a")], "id int, name string"), f"{schema}.t", "one.csv", "append")
    bronze = load_bronze(rows([("b", 2)], "name string, id int"), f"{schema}.t", "two.csv", "append")
    assert sorted(map(tuple, bronze.select("id", "name", "_source").collect())) == [(1, "a", "one.csv"), (2, "b", "two.csv")]


def test_bronze_append_refuses_unknown_columns(rows, schema):
    load_bronze(rows([(1,)], "id int"), f"{schema}.t", "one.csv")
    with pytest.raises(Exception, match="extra"):
        load_bronze(rows([(1, 2)], "id int, extra int"), f"{schema}.t", "two.csv", "append")


def test_flat(spark, rows, schema):
    name = f"{schema}.people"
    with pytest.raises(ValueError, match="does not exist"):
        load_flat(rows([(1, "a")], "id int, name string"), name, "append")
    assert load_flat(rows([(1, "a"), (2, "b")], "id int, name string"), name) == (2, 2)
    assert load_flat(rows([(3,)], "id int"), name, "append") == (1, 3)
    assert {tuple(r) for r in spark.table(name).collect()} == {(1, "a"), (2, "b"), (3, None)}
    with pytest.raises(ValueError, match="no column `city`"):
        load_flat(rows([(3, "x")], "id int, city string"), name, "append")
    assert load_flat(rows([(9, "z")], "id int, name string"), name) == (1, 1)
    with pytest.raises(ValueError, match="unknown mode"):
        load_flat(rows([(9, "z")], "id int, name string"), name, "merge")


def test_append_widens_but_does_not_cut(spark, rows, schema):
    name = f"{schema}.amounts"
    load_flat(rows([(1, 1.5)], "n bigint, v double"), name)
    assert load_flat(rows([(2, 7)], "n int, v int"), name, "append") == (1, 2)
    with pytest.raises(ValueError, match="`N` from double to bigint"):
        load_flat(rows([(2.5,)], "N double"), name, "append")
    with pytest.raises(Exception):
        load_flat(rows([("x",)], "n string"), name, "append")
    assert {tuple(r) for r in spark.table(name).collect()} == {(1, 1.5), (2, 7.0)}


def test_table_columns_leaves_lineage_out(spark, rows, schema):
    load_bronze(rows([(1,)], "id int"), f"{schema}.t", "one.csv")
    assert table_columns(spark, f"{schema}.t_bronze") == ["id"]
    assert table_columns(spark, f"{schema}.nothing") is None


def test_rewrite(spark, rows, schema):
    name = f"{schema}.t"
    load_flat(rows([(1, 10), (2, 20), (3, None)], "id int, v int"), name)
    with pytest.raises(PermissionError):
        rewrite_table(spark, name, "v > 15")
    assert rewrite_table(spark, name, "v > 15", confirm=True) == 1
    assert {tuple(r) for r in spark.table(name).collect()} == {(1, 10), (3, None)}
    assert rewrite_table(spark, name, "id = 1", {"v": "v + 1"}, confirm=True) == 1
    assert {tuple(r) for r in spark.table(name).collect()} == {(1, 11), (3, None)}
    assert rewrite_table(spark, name, "id = 99", confirm=True) == 0
    assert {t.name for t in spark.catalog.listTables(schema)} == {"t"}


def test_a_failed_swap_leaves_the_old_table(spark, rows, schema, monkeypatch):
    name = f"{schema}.t"
    load_flat(rows([(1, 10), (2, 20)], "id int, v int"), name)
    run = type(spark).sql

    def failing(self, text, *args, **kwargs):
        if "__next" in text and "RENAME" in text:
            raise RuntimeError("lost")
        return run(self, text, *args, **kwargs)

    monkeypatch.setattr(type(spark), "sql", failing)
    with pytest.raises(RuntimeError):
        rewrite_table(spark, name, "id = 1", confirm=True)
    assert {tuple(r) for r in spark.table(name).collect()} == {(1, 10), (2, 20)}


def test_update_sees_old_values(rows):
    df = rows([(1, 2), (None, 5)], "a int, b int")
    swapped = update_rows(df, {"a": "b", "b": "a"}, "a = 1")
    assert {tuple(r) for r in swapped.collect()} == {(2, 1), (None, 5)}
    with pytest.raises(ValueError):
        update_rows(df, {"c": "1"}, "a = 1")


def test_gold_names_and_null_group(rows):
    from quarryline.operators.medallion import choose_dimension, promote_gold

    df = rows([("a", 1), (None, 2), ("a", None)], "g string, v int")
    assert {tuple(r) for r in promote_gold(df, "g").collect()} == {("a", 2), (None, 1)}
    assert promote_gold(df, "g", "v", "sum").columns == ["g", "sum_v"]
    assert {tuple(r) for r in promote_gold(df, "g", "v", "COUNT").collect()} == {("a", 2), (None, 1)}
    assert choose_dimension(df) == "g"
    assert choose_dimension(df.select("v")) == "v"
    assert choose_dimension(df.select(F.lit("x").alias("same"), F.col("v").cast("string").alias("each"))) == "each"


def test_dedup_keeps_one_row_of_a_hot_key(spark):
    from quarryline.operators.medallion import dedup_latest, promote_silver
    from quarryline.sources.tables import with_lineage

    # A third of the rows share one key.
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, -1, id) as k", "id as v", "cast(id % 7 as string) as _load")
    latest = {r.k: r.v for r in dedup_latest(df, ["k"], ["v"]).collect()}
    assert len(latest) == 20_001 and latest[-1] == 29_997
    bronze = with_lineage(df.drop("_load"), "x.csv", F.timestamp_seconds(F.col("v")))
    silver = {r.k: r.v for r in promote_silver(bronze, ["k"]).collect()}
    assert silver == latest
    plan = dedup_latest(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2, "rows must be cut down before the exchange"


def test_silver_by_null_key(rows):
    from quarryline.operators.medallion import promote_silver

    bronze = rows(
        [(None, "old", 1), (None, "new", 2), (1, None, 1), (None, None, 3)], "k int, v string, _ingested_at int"
    )
    assert {tuple(r) for r in promote_silver(bronze, ["k"]).collect()} == {(None, "new"), (1, None)}
