"""Queries for conversations and dashboard commands (G1-G5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.commands import apply_filters, apply_in_force, commands_since, normalize_commands
from ..operators.dialog import spoken_digest, transcripts
from ..session import workspace
from ..sources.versions import StoredTable
from ..streaming.drops import stream_commands, stream_filters
from .base import Check, table


def _transcripts(spark, sf):
    return transcripts(table(spark, sf, "conversations"))


def _long_transcripts(spark, sf):
    """Everything each user did as one long conversation; errors say nothing."""
    events = table(spark, sf, "events").select(
        (F.col("user_id") % 3).alias("conv_id"),
        F.col("event_id").alias("turn"),
        F.when(F.col("user_id") % 2 == 0, "human").otherwise("assistant").alias("role"),
        F.when(F.col("event_type") != "error", F.concat_ws(" ", "event_type", "props")).otherwise("").alias("text"),
    )
    return transcripts(events, turns_per_part=1000)


def _digest(spark, sf):
    customers = table(spark, sf, "customer")
    order = [F.col("c_acctbal").desc(), F.col("c_custkey")]
    return spoken_digest(
        customers, "c_nationkey", ["c_name", "c_acctbal"], order, F.lit("Richest customers of the nation.")
    )


def _digest_single(spark, sf):
    """The dearest order of each customer: customers with one order are answered outright."""
    return spoken_digest(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], [F.col("o_orderkey")])


_SINGLE_SQL = """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place,
                  count(*) OVER (PARTITION BY o_custkey) AS n_rows FROM orders)
SELECT o_custkey, n_rows,
       CASE WHEN n_rows = 1 THEN 'The answer is ' || min(o_orderkey) || '.'
            ELSE 'Top results: ' || string_agg('o_orderkey ' || o_orderkey, '; ' ORDER BY place) || '.'
                 || CASE WHEN n_rows > 3 THEN ' And ' || (n_rows - 3) || ' more.' ELSE '' END END AS digest
FROM r WHERE place <= 3 GROUP BY 1, 2"""


def _sent(spark, sf) -> DataFrame:
    """Events as commands to a dashboard: one shape per event type, errors being no JSON."""
    status = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("user_id") % 3 + 1).cast("int"))
    priority = F.when(F.col("user_id") % 2 == 0, "2-HIGH").otherwise("5-LOW")
    orders = F.lit("Orders").alias("worksheet")
    def json(**fields) -> Column:
        return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))

    kind, word = F.col("event_type"), F.lit
    chosen = F.struct(orders, word("o_orderpriority").alias("field"), priority.alias("value"))
    body = (
        F.when(kind == "view", json(action=word("set_filter"), worksheet=orders, field=word("o_orderstatus"), value=status))
        .when(kind == "click", json(parameters=chosen))
        .when(kind == "purchase", json(command_type=word("set_filter"), command_value=F.col("props"), action=word("x")))
        .when(kind == "signup", json(action=word("clear"), worksheet=orders, field=word(""), value=F.col("value")))
        .otherwise(F.concat(word("oops "), "props"))
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.format_string("cmd_%s_%s", "event_id", "user_id").alias("command_id"),
        body.alias("body"),
    )


_COMMANDS_SQL = """
WITH commands AS (
  SELECT event_id AS seq, 'cmd_' || event_id || '_' || user_id AS command_id,
         CASE event_type WHEN 'error' THEN 'not json' ELSE 'ok' END AS status,
         CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 'clear' ELSE 'set_filter' END AS action,
         CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 'Stages' ELSE 'Orders' END AS worksheet,
         CASE event_type WHEN 'view' THEN 'o_orderstatus' WHEN 'click' THEN 'o_orderpriority' WHEN 'error' THEN NULL ELSE 'Stage' END AS field,
         CASE event_type WHEN 'view' THEN ['F', 'O', 'P'][user_id % 3 + 1]
                         WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN '2-HIGH' ELSE '5-LOW' END
                         WHEN 'purchase' THEN props WHEN 'error' THEN NULL ELSE CAST(value AS VARCHAR) END AS value
  FROM events)"""


def _since(spark, sf):
    """All that came after the first command of the busiest worksheet's middle day."""
    commands = normalize_commands(_sent(spark, sf))
    known = commands.orderBy("seq").first()["command_id"]
    return (
        commands_since(commands, known).withColumn("cursor", F.lit("first"))
        .unionByName(commands_since(commands, "cmd_unknown").withColumn("cursor", F.lit("unknown")))
    )


_SINCE_SQL = (
    _COMMANDS_SQL
    + """
SELECT *, 'first' AS cursor FROM commands WHERE seq > (SELECT min(seq) FROM commands)
UNION ALL SELECT *, 'unknown' FROM commands"""
)


def _streamed(spark, sf):
    """Commands dropped in two goes and read as a stream after each; a third run finds nothing new."""
    folder = workspace(spark, "commands")
    for half in (0, 1, None):
        if half is not None:
            _sent(spark, sf).where(F.col("seq") % 2 == half).write.mode("append").json(f"{folder}/in")
        stream_commands(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


def _streamed_filters(spark, sf):
    """Orders by the filters in force after commands came in two goes, the later ones first."""
    folder = workspace(spark, "filters")
    for half in (1, 0):
        _sent(spark, sf).where(F.col("seq") % 2 == half).write.mode("append").json(f"{folder}/in")
        stream_filters(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    in_force = StoredTable(spark, f"{folder}/out").read()
    return apply_in_force(table(spark, sf, "orders"), in_force, "Orders", ["o_orderstatus", "o_orderpriority"])


def _filters(spark, sf):
    orders, commands = table(spark, sf, "orders"), normalize_commands(_sent(spark, sf))
    return apply_filters(orders, commands, "Orders", ["o_orderstatus", "o_orderpriority"])


def _typed_filters(spark, sf):
    """A number, a day and a text, each set by commands as text; the field's case differs."""
    sent = spark.range(4).select(
        F.col("id").alias("seq"),
        F.lit("set_filter").alias("action"),
        F.lit("Lines").alias("worksheet"),
        F.element_at(F.array(*map(F.lit, ("L_QUANTITY", "l_shipdate", "l_returnflag", "l_quantity"))), F.col("id").cast("int") + 1).alias("field"),
        F.element_at(F.array(*map(F.lit, ("7", "1998-03-01", "N", "10"))), F.col("id").cast("int") + 1).alias("value"),
    )
    lines = table(spark, sf, "lineitem")
    by_number = apply_filters(lines, sent.where("field <> 'l_shipdate'"), "Lines")
    by_day = apply_filters(lines, sent.where("field = 'l_shipdate'"), "Lines")
    return by_number.withColumn("by", F.lit("number")).unionByName(by_day.withColumn("by", F.lit("day")))


_FILTERS_SQL = (
    _COMMANDS_SQL
    + """,
in_force AS (SELECT field, arg_max(value, seq) AS value FROM commands
             WHERE action = 'set_filter' AND worksheet = 'Orders' GROUP BY 1)
SELECT * FROM orders
WHERE o_orderstatus = coalesce((SELECT value FROM in_force WHERE field = 'o_orderstatus'), o_orderstatus)
  AND o_orderpriority = coalesce((SELECT value FROM in_force WHERE field = 'o_orderpriority'), o_orderpriority)"""
)


def _script_sql(source: str, part: str) -> str:
    return f"""
WITH turns AS ({source}),
lines AS (SELECT *, CASE WHEN role IN ('user', 'human') THEN 'You: ' ELSE 'Agent: ' END || text AS line
          FROM turns WHERE text <> ''),
spoken AS (SELECT *, {part} AS part FROM lines)
SELECT conv_id, part, string_agg(line, chr(10) ORDER BY turn NULLS FIRST, line) AS transcript, count(*) AS n_lines FROM spoken GROUP BY 1, 2
UNION ALL
SELECT DISTINCT conv_id, 0, '_(empty transcript)_', 0 FROM turns WHERE conv_id NOT IN (SELECT conv_id FROM spoken)"""


CHECKS = {
    "transcripts": Check(_transcripts, _script_sql("SELECT * FROM conversations", "((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, line)) - 1) // 10000")),
    "transcripts_long": Check(
        _long_transcripts,
        _script_sql(
            """SELECT user_id % 3 AS conv_id, event_id AS turn,
                      CASE WHEN user_id % 2 = 0 THEN 'human' ELSE 'assistant' END AS role,
                      CASE WHEN event_type <> 'error' THEN event_type || ' ' || props ELSE '' END AS text FROM events""",
            "((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, line)) - 1) // 1000",
        ),
    ),
    "spoken_digest": Check(
        _digest,
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place,
                             count(*) OVER (PARTITION BY c_nationkey) AS n_rows FROM customer)
           SELECT c_nationkey, n_rows, 'Richest customers of the nation. Top results: '
                  || string_agg('c_name ' || c_name || ', c_acctbal ' || c_acctbal, '; ' ORDER BY place) || '.'
                  || CASE WHEN n_rows > 3 THEN ' And ' || (n_rows - 3) || ' more.' ELSE '' END AS digest
           FROM r WHERE place <= 3 GROUP BY 1, 2""",
    ),
    "spoken_digest_single": Check(_digest_single, _SINGLE_SQL),
    "normalize_commands": Check(
        lambda spark, sf: normalize_commands(_sent(spark, sf)), _COMMANDS_SQL + " SELECT * FROM commands"
    ),
    "stream_commands": Check(_streamed, _COMMANDS_SQL + " SELECT * FROM commands"),
    "commands_since": Check(_since, _SINCE_SQL),
    "apply_filters": Check(_filters, _FILTERS_SQL),
    "stream_filters": Check(_streamed_filters, _FILTERS_SQL),
    "apply_filters_typed": Check(
        _typed_filters,
        """SELECT *, 'number' AS by FROM lineitem WHERE l_quantity = 10 AND l_returnflag = 'N'
           UNION ALL SELECT *, 'day' FROM lineitem WHERE l_shipdate = TIMESTAMP '1998-03-01'""",
    ),
}
