from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from quarryline.operators.infer import (
    cast_failures,
    cast_typed,
    collect_types,
    infer_states,
    infer_types,
    merge_states,
    remember_states,
    remembered_types,
    types_of,
)

CASES = {
    ("1", "-2"): "INT",
    ("2147483647",): "INT",
    ("2147483648",): "BIGINT",
    ("-2147483648",): "BIGINT",
    ("1", "3.5"): "DOUBLE",
    ("3.5", "3000000000"): "DOUBLE",
    ("1,476,625,576", "349,035,494"): "INT",
    ("3,000,000,000",): "BIGINT",
    ("1,234.50", "2"): "DOUBLE",
    ("1,23",): "VARCHAR(32)",
    ("true", "FALSE"): "BOOLEAN",
    ("true", "1"): "VARCHAR(32)",
    ("2026-07-01 09:15", "2026-07-01T09:15:00"): "DATETIME",
    ("2026-07-01 09:15:00.5",): "VARCHAR(42)",
    ("2026-07-01",): "DATE",
    ("2026-07-01", "2026-07-01 09:15"): "VARCHAR(32)",
    (" 5", "5"): "VARCHAR(32)",
    ("1e5",): "VARCHAR(32)",
    ("+5",): "VARCHAR(32)",
    (".5",): "VARCHAR(32)",
    ("5\n",): "VARCHAR(32)",
    ("-",): "VARCHAR(32)",
    ("9" * 60,): "BIGINT",
    (None, ""): "TEXT",
    (None, "7"): "INT",
    ("x" * 600,): "VARCHAR(1000)",
    ("x" * 1001,): "TEXT",
}


@pytest.mark.parametrize("values", CASES)
def test_infer(rows, values):
    df = rows([(v,) for v in values], "c string")
    assert collect_types(infer_types(df)) == {"c": CASES[values]}


def test_columns_keep_their_order_and_counts(rows):
    df = rows([("1", "a", None), ("2", None, "")], "n string, t string, e string")
    found = [tuple(r) for r in infer_types(df).orderBy("position").collect()]
    assert found == [
        (0, "n", "INT", "int", 1, 2),
        (1, "t", "VARCHAR(32)", "string", 1, 1),
        (2, "e", "TEXT", "string", 0, 0),
    ]


def test_an_empty_table_is_text(rows):
    assert collect_types(infer_types(rows([], "a string, b string"))) == {"a": "TEXT", "b": "TEXT"}


def test_cast(rows):
    import datetime as dt

    df = rows(
        [("1,000", "2.5", "TRUE", "2026-07-01T09:15", "2026-07-01", "x"), (None, "", None, None, None, None)],
        "i string, d string, b string, t string, a string, s string",
    )
    types = {"i": "INT", "d": "DOUBLE", "b": "BOOLEAN", "t": "DATETIME", "a": "DATE", "s": "VARCHAR(32)"}
    first, second = cast_typed(df, types).collect()
    assert tuple(first) == (1000, 2.5, True, dt.datetime(2026, 7, 1, 9, 15), dt.date(2026, 7, 1), "x")
    assert tuple(second) == (None,) * 6


@pytest.mark.parametrize("value, kind", [("2026-13-45", "DATE"), ("9" * 30, "BIGINT"), ("2026-02-30 10:00", "DATETIME")])
def test_values_that_do_not_fit_are_named(rows, value, kind):
    df = rows([(value,), (None,)], "when string")
    with pytest.raises(PySparkException, match="column when"):
        cast_typed(df, {"when": kind}).collect()
    assert cast_typed(df, {"when": kind}, strict=False).collect()[0][0] is None
    assert [tuple(r) for r in cast_failures(df, {"when": kind}).collect()] == [("when", kind, 1)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=30))
def test_integers_survive(spark, numbers):
    df = spark.createDataFrame([(str(n),) for n in numbers], "c string").coalesce(1)
    types = collect_types(infer_types(df))
    assert types["c"] == ("BIGINT" if any(abs(n) > 2147483647 for n in numbers) else "INT")
    assert [r.c for r in cast_typed(df, types).collect()] == numbers


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes().map(lambda d: d.replace(microsecond=0)), min_size=1, max_size=20))
def test_moments_survive(spark, moments):
    df = spark.createDataFrame([(m.strftime("%Y-%m-%d %H:%M:%S").zfill(19),) for m in moments], "c string").coalesce(1)
    types = collect_types(infer_types(df))
    assert types["c"] == "DATETIME"
    assert [r.c for r in cast_typed(df, types).collect()] == moments


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["", "7", "-2147483648", "3.5", "true", "2026-07-01", "2026-07-01 09:15", "x" * 40, "1,234"]), max_size=4), min_size=1, max_size=4))
def test_states_of_parts_make_the_state_of_the_whole(spark, parts):
    frames = [spark.createDataFrame([(v, v) for v in part], "a string, b string").coalesce(1) for part in parts]
    whole = spark.createDataFrame([(v, v) for part in parts for v in part], "a string, b string").coalesce(1)
    states = reduce(lambda x, y: x.union(y), [infer_states(f) for f in frames])
    assert sorted(types_of(merge_states(states)).collect()) == sorted(infer_types(whole).collect())


def test_a_further_file_widens_types_and_earlier_ones_are_not_read(spark, rows, tmp_path):
    folder = str(tmp_path / "states")
    remember_states(rows([("1", "2026-07-01")], "n string, day string"), folder, "one.csv")
    assert collect_types(remembered_types(spark, folder)) == {"n": "INT", "day": "DATE"}
    remember_states(rows([("3.5", "later"), ("2", None)], "n string, day string"), folder, "two.csv")
    remember_states(rows([("x", "7")], "place string, n string"), folder, "three.csv")
    assert collect_types(remembered_types(spark, folder)) == {"n": "DOUBLE", "place": "VARCHAR(32)", "day": "VARCHAR(32)"}
    remember_states(rows([("4", "2026-07-02")], "n string, day string"), folder, "two.csv")  # the file came again
    found = {r.column: (r.inferred, r.n_present) for r in remembered_types(spark, folder).collect()}
    assert found == {"n": ("INT", 3), "place": ("VARCHAR(32)", 1), "day": ("DATE", 2)}
