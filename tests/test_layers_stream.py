import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarryline.operators.medallion import promote_gold, promote_silver
from quarryline.sources.tables import INGESTED_AT
from quarryline.sources.versions import KeyedTable
from quarryline.streaming import layers
from quarryline.streaming.layers import LayerSpec, read_gold, read_silver, stream_layers

NAMES = ["id", "place", "price"]


@pytest.fixture
def loads(rows, tmp_path):
    """Three loads of a table of orders: corrections, repeats, rows without values, rows older than what is held."""

    def load(hour, data):
        at = F.lit(dt.datetime(2026, 7, 1, hour)).cast("timestamp_ntz")
        return rows(data, "id int, place string, price double").withColumn(INGESTED_AT, at).withColumn("_source", F.lit(f"{hour}.csv"))

    return [
        load(2, [(i, "abc"[i % 3], float(i)) for i in range(30)] + [(None, None, None), (40, None, 1.5)]),
        load(3, [(i, "abcd"[i % 4], None if i % 5 == 0 else i / 2) for i in range(20, 50)] + [(3, "a", 3.0)]),
        load(1, [(i, "z", 99.0) for i in range(28, 55)] + [(None, "z", 1.0)]),
    ]


def appended(spark, loads, tmp_path, spec):
    bronze, out, checkpoint = (str(tmp_path / n) for n in ("bronze", "out", "checkpoint"))
    read = []
    for load in loads:
        load.coalesce(1).write.mode("append").parquet(bronze)
        read.append(stream_layers(spark, bronze, out, checkpoint, spec))
    return out, read


@pytest.mark.parametrize("aggregation, key", [("COUNT", ["id"]), ("AVG", ["id"]), ("COUNTD", ["id"]), ("SUM", None), ("MAX", None)])
def test_three_appends_equal_one_build(spark, loads, tmp_path, aggregation, key):
    spec = LayerSpec(NAMES, key, "place", None if aggregation == "COUNT" else "price", aggregation, buckets=2)
    out, read = appended(spark, loads, tmp_path, spec)
    assert read == [load.count() for load in loads]  # each row once: earlier files are not read again
    bronze = loads[0].union(loads[1]).union(loads[2])
    silver = promote_silver(bronze, key)
    assert sorted(map(repr, read_silver(spark, out, spec).collect())) == sorted(map(repr, silver.collect()))
    gold = promote_gold(silver, "place", spec.measure, aggregation)
    found = read_gold(spark, out, spec)
    assert found.columns == gold.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, gold.collect()))


def test_the_dimension_is_chosen_once(spark, loads, tmp_path):
    spec = LayerSpec(NAMES, ["id"], buckets=4)
    out, _ = appended(spark, loads, tmp_path, spec)
    assert read_gold(spark, out, spec).columns == ["place", "count_rows"]


def test_a_batch_that_stops_between_silver_and_gold_counts_once(spark, loads, tmp_path, monkeypatch):
    spec = LayerSpec(NAMES, ["id"], "place", "price", "SUM", buckets=4)
    bronze, out, checkpoint = (str(tmp_path / n) for n in ("bronze", "out", "checkpoint"))
    for i, load in enumerate(loads):
        load.coalesce(1).write.mode("append").parquet(bronze)
        if i == 1:
            with monkeypatch.context() as patch:
                patch.setattr(layers, "_states", lambda *a: 1 / 0)
                with pytest.raises(Exception):
                    stream_layers(spark, bronze, out, checkpoint, spec)
        stream_layers(spark, bronze, out, checkpoint, spec)
    silver = promote_silver(loads[0].union(loads[1]).union(loads[2]), ["id"])
    want = promote_gold(silver, "place", "price", "SUM")
    assert sorted(map(repr, read_gold(spark, out, spec).collect())) == sorted(map(repr, want.collect()))


def test_bronze_must_have_the_columns(spark, loads, tmp_path):
    loads[0].write.parquet(str(tmp_path / "bronze"))
    with pytest.raises(ValueError, match="city"):
        stream_layers(spark, str(tmp_path / "bronze"), str(tmp_path / "out"), str(tmp_path / "c"), LayerSpec(["id", "city"]))


def test_a_merge_opens_the_buckets_of_its_keys_only(spark, rows, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 16)

    def newest(df):
        return df.groupBy("k").agg(F.max_by("v", "_new").alias("v"))

    table.merge(spark.range(400).select(F.col("id").alias("k"), F.lit(0).alias("v")), newest)
    before = table.files()
    change = table.merge(rows([(7, 1), (1000, 1)], "k bigint, v int"), newest, {"by": "me"})
    assert len(change.replaced) <= 2 and change.kept >= len(before) - 2 and table.notes() == {"by": "me"}
    found = {r.k: r.v for r in table.read().collect()}
    assert len(found) == 401 and {k for k, v in found.items() if v} == {7, 1000}
    change = table.delete("k = 1000", confirm=True)
    assert change.rows == 1 and len(change.replaced) == 1 and table.read().count() == 400
    assert table.notes() == {"by": "me"}
    assert table.merge(rows([], "k bigint, v int"), newest).replaced == []
