"""Running one guarded statement."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import classify_statements, degenerate_reason, strip_literals
from .guard import objections

# Commands that only tell something.
_TELLING = ("Show", "Describe", "Explain", "SetNamespace", "SetCatalog", "Use", "GetColumns")


class Refused(ValueError):
    """The statement is not one that may be run."""


class NeedsConfirmation(Refused):
    """The statement changes data and nobody has confirmed it."""


def changes_data(spark: SparkSession, sql: str) -> bool:
    """Whether Spark's own parser finds an insert or a command that does more than tell something, at any depth."""
    logical = "org.apache.spark.sql.catalyst.plans.logical"
    command, plan = (spark._jvm.java.lang.Class.forName(f"{logical}.{name}") for name in ("Command", "LogicalPlan"))
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if "Insert" in name or (command.isInstance(node) and not name.startswith(_TELLING)):
            return True
        for parts in (node.children(), node.innerChildren(), node.subqueries()):
            found = [parts.apply(i) for i in range(parts.size())]
            todo += [part for part in found if plan.isInstance(part)]
    return False


def _run(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The statement with tables as views of their own session, so that nobody else's views are touched."""
    if not tables:
        return spark.sql(sql)
    held = {}
    for name, table in tables.items():
        known = spark.catalog._jcatalog.tableExists(name) and spark.catalog.getTable(name).isTemporary
        held[name] = spark.table(name) if known else None
        table.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name, before in held.items():
            spark.catalog.dropTempView(name)
            if before is not None:
                before.createOrReplaceTempView(name)


def answer_sql(
    spark: SparkSession,
    sql: str,
    tables: dict[str, DataFrame] | None = None,
    confirm: bool = False,
    limit: int | None = None,
    functions: Collection[str] = (),
) -> DataFrame:
    """Judges a statement and hands it to Spark SQL, the tables registered as views until it is planned.

    What the text says is checked against the plan that Spark's parser makes of it: a statement that reads like a query
    and holds an insert or a command is refused, and so is one that calls a function other than Spark's harmless ones and
    those named in ``functions``, or that reads anything but ``tables`` (without any: what the catalog knows). Files are never
    read or written by their path. Answers are whole; with ``limit``, a SELECT that does not end in a LIMIT of its own is
    answered with so many of its first rows.
    """
    judged = classify_statements(spark.range(1).select(F.lit(sql).alias("sql")), "sql")
    ends_limited = F.lower(strip_literals(F.col("sql"))).rlike(r"\blimit \w+( offset \w+)? ?;*\z")
    rows = F.lower(strip_literals(F.col("sql"))).rlike(r"^(select|with)\b")
    verdict = judged.select(
        "*", degenerate_reason(F.col("sql")).alias("malformed"), ends_limited.alias("limited"), rows.alias("rows")
    ).first()
    if verdict["malformed"]:
        raise Refused(verdict["malformed"])
    if not verdict["ok"]:
        raise Refused(verdict["reason"])
    statement = sql.strip().rstrip("; \n\t")
    if verdict["kind"] == "read" and changes_data(spark, statement):
        raise Refused("the statement reads like a query and changes data")
    objection = next(objections(spark, statement, tables or (), verdict["kind"] == "read", functions), None)
    if objection:
        raise Refused(f"the statement uses {objection}")
    if verdict["needs_confirmation"] and not confirm:
        raise NeedsConfirmation(f"this changes data and was not run: {sql}")
    answer = _run(spark, statement, tables or {})
    return answer.limit(limit) if limit is not None and verdict["rows"] and not verdict["limited"] else answer
