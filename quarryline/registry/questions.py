"""Queries for questions and changes to a table (E1-E9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.rows import count_per_group, delete_rows, last_n_per_user, preview, top_k, update_rows
from ..plans.answer import answer_sql
from ..session import workspace
from ..sources.versions import StoredTable
from .base import Check, table

_QUESTION = """
SELECT n_name, o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus <> 'P' GROUP BY n_name, o_orderpriority"""


def _answer(spark, sf):
    tables = {name: table(spark, sf, name) for name in ("orders", "customer", "nation")}
    return answer_sql(spark, _QUESTION + ";", tables, limit=None)


def _answer_top(spark, sf):
    question = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"
    return answer_sql(spark, question, {"orders": table(spark, sf, "orders")}, limit=100)


_PREDICATE = "value < 20 AND event_type <> 'view'"
_MAYBE = "CASE WHEN event_type <> 'error' THEN value END"


def _delete(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value", F.expr(_MAYBE).alias("known"))
    return delete_rows(events, "known < 20").drop("known")


def _update(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return update_rows(events, {"value": "round(value * 2, 2)", "event_type": "concat(event_type, '_low')"}, _PREDICATE)


def _stored(spark, sf, assignments=None):
    """Events stored, changed where they are, and read back with the count of rows concerned."""
    stored = StoredTable(spark, workspace(spark, "stored"))
    stored.replace(table(spark, sf, "events").select("event_id", "event_type", "value"))
    change = stored.change(_PREDICATE, assignments, confirm=True)
    return stored.read().withColumn("affected", F.lit(change.rows).cast("bigint"))


_AFFECTED = f"(SELECT count(*) FROM events WHERE {_PREDICATE}) AS affected"


def _last_n(spark, sf):
    return last_n_per_user(table(spark, sf, "events"), "user_id", ["ts", "event_id"])


def _last_executed(spark, sf):
    """Only events that succeeded are remembered."""
    done = table(spark, sf, "events").filter(F.col("event_type") != "error")
    return last_n_per_user(done, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


CHECKS = {
    "delete_stored": Check(
        _stored, f"SELECT event_id, event_type, value, {_AFFECTED} FROM events WHERE ({_PREDICATE}) IS NOT TRUE"
    ),
    "update_stored": Check(
        lambda spark, sf: _stored(spark, sf, {"value": "round(value * 2, 2)"}),
        f"""SELECT event_id, event_type, CASE WHEN {_PREDICATE} THEN round(value * 2, 2) ELSE value END AS value, {_AFFECTED}
            FROM events""",
    ),
    "answer_sql": Check(_answer, _QUESTION),
    "answer_sql_default_limit": Check(
        _answer_top, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"
    ),
    "count_per_group": Check(
        lambda spark, sf: count_per_group(table(spark, sf, "events"), ["event_type"]),
        "SELECT event_type, count(*) AS count_rows FROM events GROUP BY 1 ORDER BY 2 DESC, 1",
    ),
    "top_k": Check(
        lambda spark, sf: top_k(table(spark, sf, "orders"), "o_totalprice", 5, ["o_orderkey"]),
        "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    ),
    "preview": Check(
        lambda spark, sf: preview(table(spark, sf, "orders"), 20, ["o_orderkey"]),
        "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20",
    ),
    "delete_rows": Check(
        _delete,
        "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' OR NOT value < 20",
    ),
    "update_rows": Check(
        _update,
        f"""SELECT event_id, user_id, CASE WHEN {_PREDICATE} THEN event_type || '_low' ELSE event_type END AS event_type,
                   CASE WHEN {_PREDICATE} THEN round(value * 2, 2) ELSE value END AS value FROM events""",
    ),
    "last_n_per_user": Check(
        _last_n,
        """SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""",
    ),
    "last_n_executed": Check(
        _last_executed,
        """SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'error'
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""",
    ),
}
