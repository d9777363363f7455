import threading

import pytest
from pyspark.sql import functions as F

from quarryline.sources.versions import Conflict, StoredTable


@pytest.fixture
def stored(spark, tmp_path):
    return StoredTable(spark, str(tmp_path / "table"))


def test_one_changed_row_rewrites_one_of_a_thousand_files(spark, tmp_path, stored):
    rows = spark.range(0, 1000, 1, 4).select("id", (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1")
    try:
        stored.replace(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    before = set(stored.files())
    assert len(before) == 1000
    change = stored.update({"v": "v + 1"}, "id = 17", confirm=True)
    assert (change.version, change.rows, len(change.replaced), change.kept) == (2, 1, 1, 999)
    assert len(before & set(stored.files())) == 999
    assert {tuple(r) for r in stored.read().collect()} == {(i, 2 * i + (i == 17)) for i in range(1000)}
    change = stored.delete("id IN (17, 18)", confirm=True)
    assert (change.rows, len(change.replaced), change.kept) == (2, 2, 998)
    assert stored.read().count() == 998


def test_changes_follow_three_valued_logic(rows, stored):
    stored.replace(rows([(1, 10), (2, 20), (3, None)], "id int, v int"))
    with pytest.raises(PermissionError):
        stored.delete("v > 15")
    assert stored.delete("v > 15", confirm=True).rows == 1
    assert stored.update({"v": "id + 100"}, "v IS NULL", confirm=True).rows == 1
    assert {tuple(r) for r in stored.read().collect()} == {(1, 10), (3, 103)}
    with pytest.raises(ValueError):
        stored.update({"nothing": "1"}, "id = 1", confirm=True)


def test_no_row_makes_no_version(rows, stored):
    stored.replace(rows([(1, 10)], "id int, v int"))
    assert stored.delete("id = 99", confirm=True).version == 1 and stored.versions() == [1]


def test_readers_keep_their_version_and_new_ones_see_the_next(rows, stored):
    stored.replace(rows([(1, 10), (2, 20)], "id int, v int"))
    opened = stored.read()
    stored.delete("id = 1", confirm=True)
    stored.delete("id = 2", confirm=True)
    assert opened.count() == 2 and stored.read(1).count() == 2
    assert stored.read(2).count() == 1
    empty = stored.read()
    assert empty.count() == 0 and empty.dtypes == [("id", "int"), ("v", "int")]
    with pytest.raises(ValueError):
        stored.read(9)


def test_a_reader_during_changes_sees_one_version_or_the_next(spark, rows, stored):
    """Every version gives all rows the same number; no reader may see two numbers, or none."""
    stored.replace(spark.range(0, 200, 1, 4).select("id", F.lit(0).alias("n")))
    done, seen = threading.Event(), []

    def look():
        while not done.is_set():
            seen.append({(r.n, r["count"]) for r in stored.read().groupBy("n").count().collect()})

    reader = threading.Thread(target=look)
    reader.start()
    for _ in range(4):
        stored.update({"n": "n + 1"}, "true", confirm=True)
    done.set()
    reader.join()
    assert seen and all(len(s) == 1 and next(iter(s))[1] == 200 for s in seen)


def test_of_two_changes_to_one_version_one_is_refused(rows, stored, monkeypatch):
    stored.replace(rows([(1, 10), (2, 20)], "id int, v int"))
    other = StoredTable(stored._spark, stored._folder.path)
    write = StoredTable._written

    def meanwhile(self, frame):
        monkeypatch.setattr(StoredTable, "_written", write)
        other.delete("id = 2", confirm=True)
        return write(self, frame)

    monkeypatch.setattr(StoredTable, "_written", meanwhile)
    with pytest.raises(Conflict):
        stored.update({"v": "0"}, "id = 1", confirm=True)
    assert [tuple(r) for r in stored.read().collect()] == [(1, 10)] and stored.versions() == [1, 2]
    assert not [n for n in stored._folder.names("versions") if n.startswith("_")]


def test_append_goes_by_name(rows, stored):
    stored.replace(rows([(1, "a")], "id bigint, name string").coalesce(1))
    change = stored.append(rows([("b",), (None,)], "Name string"))
    assert (change.rows, change.kept) == (2, 1)
    assert {tuple(r) for r in stored.read().collect()} == {(1, "a"), (None, "b"), (None, None)}
    with pytest.raises(ValueError, match="city"):
        stored.append(rows([("x",)], "city string"))


def test_expired_versions_take_their_files_along(rows, stored):
    stored.replace(rows([(1, 10), (2, 20)], "id int, v int").repartition(2, "id"))
    stored.update({"v": "0"}, "id = 1", confirm=True)
    left = set(stored.files())
    assert len(stored.expire()) >= 1
    assert stored.versions() == [2] and set(stored.files()) == left
    assert {tuple(r) for r in stored.read().collect()} == {(1, 0), (2, 20)}
    with pytest.raises(ValueError):
        stored.read(1)


def test_a_table_that_is_not_there(stored):
    with pytest.raises(ValueError, match="no such version"):
        stored.read()
