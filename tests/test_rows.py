from pyspark.sql import functions as F

from quarryline.operators.rows import count_per_group, delete_rows, last_n_per_user, preview, top_k


def test_counts_top_and_preview(rows):
    df = rows([("a", 1), ("b", 5), ("a", 3), (None, None)], "g string, v int")
    assert [tuple(r) for r in count_per_group(df, ["g"]).collect()] == [("a", 2), (None, 1), ("b", 1)]
    assert [r.v for r in top_k(df, "v", 2, ["g"]).collect()] == [5, 3]
    assert [r.v for r in preview(df.filter("v is not null"), 2, ["v"]).collect()] == [1, 3]


def test_unknown_does_not_delete(rows):
    df = rows([(1,), (5,), (None,)], "v int")
    assert {r.v for r in delete_rows(df, "v > 3").collect()} == {1, None}
    assert {r.v for r in delete_rows(df, F.col("v") < 3).collect()} == {5, None}


def test_last_n_of_a_hot_user(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, -1, id % 100) as user", "id")
    latest = last_n_per_user(df, "user", ["id"], n=3)
    assert latest.groupBy("user").count().filter("count <> 3").count() == 0
    assert sorted(r.id for r in latest.filter("user = -1").collect()) == [29_991, 29_994, 29_997]
    assert latest._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_top_k_is_not_a_full_sort(spark):
    plan = top_k(spark.range(1000), "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan
