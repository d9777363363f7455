import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.operators.audit import classify_statements, degenerate_sql, review_replies, split_statements, strip_literals
from quarryline.plans.answer import NeedsConfirmation, Refused, answer_sql, changes_data

VERDICTS = [
    ("SELECT 1", True, "read"),
    ("select * from t;", True, "read"),
    ("DROP TABLE t", True, "destructive"),
    ("SELECT 1; DROP TABLE t", False, "unknown"),
    ("CREATE OR REPLACE TABLE t AS SELECT 1", True, "destructive"),
    ("create\ttemporary view v as select 1", True, "create"),
    ("SELECT * FROM t WHERE note = 'please drop table x'", True, "read"),
    ("SELECT replace(email,'-','') FROM t", True, "read"),
    ("SELECT replace (email,'-','') FROM t", True, "read"),
    ("INSERT OVERWRITE t SELECT 1", True, "destructive"),
    ("INSERT INTO t VALUES (1)", True, "create"),
    ("CREATE USER bob", False, "unknown"),
    ("CREATE TABLESPACE x", False, "unknown"),
    ("WITH x AS (SELECT 1) DELETE FROM t", False, "destructive"),
    ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", False, "destructive"),
    ("SELECT '--'; DROP TABLE t", False, "unknown"),
    ("SELECT 'drop -- b'", True, "read"),
    ("SELECT \"it's; fine\"", True, "read"),
    ("SELECT 'it''s; fine'", True, "read"),
    ("SELECT 'a\\'; DROP TABLE t --'", True, "read"),
    ("SELECT 1 /* ; DROP TABLE t */", True, "read"),
    ("SELECT 1 # ; DROP TABLE t", True, "read"),
    ("DROP/**/TABLE t", True, "destructive"),
    ("/* hi */ GRANT SELECT ON t TO bob", True, "destructive"),
    ("SELECT * INTO OUTFILE '/x' FROM t", False, "destructive"),
    ("SELECT dropped, updates FROM t", True, "read"),
    ("SELECT a.drop FROM a", False, "destructive"),
    ("EXPLAIN SELECT 1", True, "read"),
    ("OPTIMIZE t", True, "destructive"),
    ("PURGE t", False, "unknown"),
    ("SELECT java_method('java.lang.System', 'setProperty', 'a', '1')", False, "unknown"),
    ("SELECT system.builtin.`REFLECT` /* x */ ('a', 'b')", False, "unknown"),
    ("INSERT INTO t SELECT try_reflect('a', 'b')", False, "unknown"),
    ("SELECT IDENTIFIER('java_' || 'method')('a', 'b')", False, "unknown"),
    ("SELECT count(*) FROM csv.`/etc/passwd`", False, "unknown"),
    ("SELECT * FROM a, `text`.`notes`", False, "unknown"),
    ("DROP TABLE parquet.`s3://x/y`", False, "unknown"),
    ("SELECT reflect, t.csv, 'reflect(x)' FROM t WHERE c = 'csv.`/a`'", True, "read"),
    ("123", False, "unknown"),
    ("  \n ", False, "unknown"),
    ("-- only a remark", False, "unknown"),
    (";;", False, "unknown"),
    (None, False, "unknown"),
]


def test_verdicts(rows):
    df = rows([(i, v[0]) for i, v in enumerate(VERDICTS)], "i int, sql string")
    found = classify_statements(df, "sql").orderBy("i").collect()
    assert [(r.sql, r.ok, r.kind) for r in found] == VERDICTS
    for r in found:
        assert r.ok == (r.reason == "")
        assert r.needs_confirmation == (r.kind == "destructive") and r.needs_write == (r.kind != "read")


REASONS = {
    "": "empty SQL",
    "-- x": "no executable statement",
    "SELECT 1; SELECT 2; SELECT 3": "3 statements at once; send one",
    "CREATE USER bob": 'unrecognised statement type: "create"',
    "WITH x AS (SELECT 1) MERGE INTO t USING x WHEN MATCHED THEN DELETE": 'read statement contains "DELETE"',
    "SELECT * INTO DUMPFILE 'x' FROM t": "read statement writes to a file",
    "SELECT Reflect('a', 'b')": 'statement calls "reflect"',
    "SELECT * FROM json.`a`": "statement names a file as a table",
}


def test_reasons(rows):
    found = classify_statements(rows([(s,) for s in REASONS], "sql string"), "sql").collect()
    assert {r.sql: r.reason for r in found} == REASONS


def test_splitting(rows):
    df = rows([("a; 'x;y' ;; b -- ; c\n; d",)], "sql string")
    assert df.select(split_statements(F.col("sql")).alias("s")).first().s == ["a", "b", "d"]


@pytest.mark.parametrize("size", [100_000])
@pytest.mark.parametrize("piece", ["x", "''", "\\'", "it''s ", "-", "/*"])
def test_long_literals(rows, size, piece):
    """Literals of any length are taken whole, however many quotes they hold."""
    text = f"SELECT '{piece * (size // len(piece))}' FROM t; DROP TABLE t"
    df = rows([(text,)], "sql string").select(split_statements(F.col("sql")).alias("s"))
    assert df.first().s == ["SELECT FROM t", "DROP TABLE t"]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab';\"\\-#/* \n", max_size=25), min_size=1, max_size=40))
def test_a_literal_never_changes_the_verdict(spark, texts):
    """Quoting any text properly hides it: the verdict is that of the statement without it."""
    quoted = [t.replace("\\", "\\\\").replace("'", "''") for t in texts]
    df = spark.createDataFrame([(f"SELECT '{q}' FROM t",) for q in quoted], "sql string").coalesce(1)
    judged = classify_statements(df, "sql").withColumn("stripped", strip_literals(F.col("sql"))).collect()
    assert {(r.ok, r.kind, r.stripped) for r in judged} == {(True, "read", "SELECT FROM t")}


DEGENERATE = {
    "SELECT * FROM t WHERE c IN ('', '')": "contains empty string literals",
    "SELECT * FROM t WHERE c = ''": "contains empty string literals",
    "INSERT INTO t VALUES (1, '')": "contains empty string literals",
    "SELECT 'it": "unbalanced single quotes",
    "SELECT `a FROM t": "unbalanced backticks",
    " ": "empty SQL",
    "SELECT coalesce(c, 'x') FROM t": None,
    "SELECT '' || c FROM t": None,
    "SELECT 'it''s'": None,
}


def test_degenerate(rows):
    found = degenerate_sql(rows([(s,) for s in DEGENERATE], "sql string"), "sql").collect()
    assert {r.sql: r.degenerate for r in found} == DEGENERATE


REPLIES = [
    ('{"sql": "SELECT 1;", "explanation": "one"}', (True, "read", "", "SELECT 1", "one", False)),
    ('Here:\n```sql\n{"sql": "DROP TABLE t"}\n```', (True, "destructive", "", "DROP TABLE t", "", True)),
    ('{"sql": "", "explanation": "no such column"}', (False, "unknown", "no such column", "", "no such column", False)),
    ('{"sql": ""}', (False, "unknown", "cannot answer from the schema", "", "", False)),
    ("I cannot.", (False, "unknown", "reply is not JSON", "", "", False)),
    (
        """{"sql": "SELECT * FROM t WHERE c IN ('Brazil', '')"}""",
        (False, "unknown", "malformed SQL: contains empty string literals", "SELECT * FROM t WHERE c IN ('Brazil', '')", "", False),
    ),
    (
        """{"sql": "SELECT * FROM t WHERE c = 'Brazil' ; ;"}""",
        (True, "read", "", "SELECT * FROM t WHERE c = 'Brazil' ; ", "", False),
    ),
    (
        '{"sql": "SELECT 1; DROP TABLE t"}',
        (False, "unknown", "2 statements at once; send one", "SELECT 1; DROP TABLE t", "", False),
    ),
]


def test_replies(rows):
    df = rows([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    found = review_replies(df, "reply").orderBy("i").drop("i", "reply").collect()
    assert [tuple(r) for r in found] == [expected for _, expected in REPLIES]


def test_answers(spark, rows):
    tables = {"numbers": spark.range(500).withColumnRenamed("id", "n")}
    assert answer_sql(spark, "SELECT n FROM numbers;", tables).count() == 500
    assert answer_sql(spark, "SELECT n FROM numbers;", tables, limit=100).count() == 100
    assert answer_sql(spark, "SELECT n FROM numbers LIMIT 300", tables, limit=100).count() == 300
    assert answer_sql(spark, "SELECT n FROM (SELECT n FROM numbers LIMIT 400)", tables, limit=100).count() == 100
    assert answer_sql(spark, "SELECT count(*) AS c FROM numbers", tables).first().c == 500
    assert "numbers" in {r.tableName for r in answer_sql(spark, "SHOW TABLES", tables).collect()}
    assert answer_sql(spark, "DESCRIBE numbers", tables).first().col_name == "n"


def test_views_are_the_callers_again(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    answer = answer_sql(spark, "SELECT * FROM numbers", {"numbers": spark.range(5), "others": spark.range(1)})
    assert answer.count() == 5 and spark.table("numbers").count() == 3
    assert not spark.catalog.tableExists("others")
    spark.catalog.dropTempView("numbers")


HIDDEN = [
    "WITH x AS (SELECT r'\\' AS p) INSERT OVERWRITE {t} SELECT concat(p, 'y') FROM x",
    "WITH x AS (SELECT 'n' AS p) /* /* */ ' */ INSERT OVERWRITE {t} SELECT p FROM x --'",
    "WITH x AS (SELECT 'c' AS p) --\rINSERT OVERWRITE {t} SELECT p FROM x",
    "WITH x AS (SELECT 'c' AS p) -- \\\n '\nINSERT OVERWRITE {t} SELECT p FROM x --'",
    "WITH x AS (SELECT 'c' AS `a'b`) INSERT OVERWRITE {t} SELECT * FROM x --'",
]


@pytest.mark.parametrize("text", HIDDEN)
def test_hidden_inserts_are_refused(spark, rows, schema, text):
    name = f"{schema}.t"
    answer_sql(spark, f"CREATE TABLE {name} USING parquet AS SELECT 'kept' AS p")
    sql = text.format(t=name)
    assert changes_data(spark, sql)
    judged = classify_statements(rows([(sql,)], "sql string"), "sql").first()
    assert not judged.ok and judged.kind != "read"
    with pytest.raises(Refused):
        answer_sql(spark, sql)
    assert [r.p for r in spark.table(name).collect()] == ["kept"]


def test_refusals(spark, schema):
    for sql in ("SELECT 1; DROP TABLE t", "CREATE USER bob", "", "SELECT * FROM t WHERE c IN ('', '')"):
        with pytest.raises(Refused):
            answer_sql(spark, sql)
    answer_sql(spark, f"CREATE TABLE {schema}.t USING parquet AS SELECT 1 AS a")
    with pytest.raises(NeedsConfirmation):
        answer_sql(spark, f"DROP TABLE {schema}.t")
    assert spark.catalog.tableExists(f"{schema}.t")
    answer_sql(spark, f"DROP TABLE {schema}.t", confirm=True)
    assert not spark.catalog.tableExists(f"{schema}.t")


REACHING = [
    "SELECT java_method('java.lang.System', 'setProperty', 'quarryline.reached', '1')",
    "SELECT try_reflect('java.lang.System', 'setProperty', 'quarryline.reached', '1')",
    "EXPLAIN SELECT reflect('java.lang.System', 'setProperty', 'quarryline.reached', '1')",
    "DESCRIBE QUERY SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "WITH x AS (SELECT 1 AS a) SELECT (SELECT max(reflect('a', 'b', a)) FROM x) FROM numbers",
    "SELECT * FROM numbers WHERE n IN (SELECT n FROM numbers WHERE system.builtin.java_method('a', 'b') = 'c')",
    "SELECT IDENTIFIER('java_' || 'method')('a', 'b')",
    "SELECT * FROM IDENTIFIER('csv.`/etc/passwd`')",
    "SELECT count(*) FROM csv.`/etc/passwd`",
    "SELECT * FROM numbers UNION ALL SELECT value FROM `text`.`/etc/passwd`",
    "DESCRIBE csv.`/etc/passwd`",
    "SELECT input_file_name() FROM numbers",
    "SELECT from_protobuf(n, 'm', '/etc/passwd') FROM numbers",
    "SELECT * FROM python_worker_logs()",
    "SELECT TRANSFORM(n) USING 'cat' FROM numbers",
    "SELECT my_own(n) FROM numbers",
    "SELECT * FROM elsewhere",
    "CREATE TABLE {t} USING csv LOCATION '/etc'",
    "CREATE TABLE {t} USING csv OPTIONS (path '/etc/passwd')",
    "CREATE TEMPORARY VIEW v USING csv OPTIONS (path '/etc/passwd')",
    "INSERT OVERWRITE DIRECTORY '/tmp/quarryline-reached' USING parquet SELECT 1",
    "INSERT INTO csv.`/tmp/quarryline-reached` SELECT 1",
    "ALTER TABLE {t} SET LOCATION '/etc'",
]


@pytest.mark.parametrize("text", REACHING)
def test_statements_reach_tables_and_nothing_else(spark, schema, text):
    spark.udf.register("my_own", lambda n: n, "long")
    spark.range(1).createOrReplaceTempView("elsewhere")
    try:
        with pytest.raises(Refused):
            answer_sql(spark, text.format(t=f"{schema}.t"), {"numbers": spark.range(5).toDF("n")}, confirm=True)
    finally:
        spark.catalog.dropTempView("elsewhere")
    assert spark._jvm.java.lang.System.getProperty("quarryline.reached") is None


ALLOWED = [
    "WITH x AS (SELECT n, n % 2 AS odd FROM numbers), y AS (SELECT * FROM x) SELECT odd, sum(n) OVER (PARTITION BY odd ORDER BY n) FROM y",
    "SELECT odd, count(DISTINCT n) FILTER (WHERE n > 1) FROM (SELECT n, n % 2 AS odd FROM numbers) GROUP BY GROUPING SETS ((odd), ()) HAVING count(*) > 0",
    "SELECT a.n FROM numbers a LEFT ANTI JOIN Numbers b ON a.n = b.n + 1 ORDER BY 1 LIMIT 3 OFFSET 0",
    "SELECT * FROM numbers LATERAL VIEW explode(sequence(0, n)) t AS m WHERE EXISTS (SELECT 1 FROM numbers c WHERE c.n = m)",
    "SELECT n, k FROM numbers, LATERAL (SELECT n + 1 AS k)",
    "SELECT * FROM (SELECT n % 2 AS odd, n FROM numbers) PIVOT (sum(n) FOR odd IN (0, 1))",
    "SELECT id FROM range(3) EXCEPT SELECT n FROM numbers INTERSECT SELECT col1 FROM VALUES (1), (2)",
    "SELECT transform(array(n), x -> upper(concat(x, 'a'))) AS u, extract(YEAR FROM current_date()) AS y, md5('a') FROM numbers",
    "SELECT n FROM numbers |> WHERE n > 2 |> AGGREGATE sum(n) AS s",
    "EXPLAIN SELECT * FROM numbers TABLESAMPLE (10 ROWS)",
    "SELECT my_own(n) FROM numbers",
]


@pytest.mark.parametrize("text", ALLOWED)
def test_queries_of_all_kinds_are_answered(spark, text):
    spark.udf.register("my_own", lambda n: n, "long")
    answer = answer_sql(spark, text, {"numbers": spark.range(5).toDF("n")}, functions=["my_own"])
    assert answer.count() >= 0


def test_without_tables_the_catalog_is_asked(spark, rows, schema):
    answer_sql(spark, f"CREATE TABLE {schema}.t USING parquet AS SELECT 1 AS a")
    assert answer_sql(spark, f"SELECT a FROM {schema}.t").first().a == 1
    answer_sql(spark, f"INSERT INTO {schema}.t SELECT n FROM numbers", {"numbers": spark.range(2).toDF("n").selectExpr("int(n) AS n")})
    assert answer_sql(spark, f"SELECT count(*) AS c FROM {schema}.t").first().c == 3
    with pytest.raises(Refused, match="the table"):
        answer_sql(spark, f"SELECT a FROM {schema}.other")
    with pytest.raises(Refused, match="the table"):
        answer_sql(spark, f"SELECT a FROM {schema}.t", {"numbers": spark.range(2)})
