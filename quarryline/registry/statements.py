"""Queries that judge statements (F1-F6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.audit import audit_rollup, classify_statements, degenerate_sql, review_replies, strip_literals
from .base import Check, sql_text, table

# Text before and after an event's properties; an event's number picks its statement.
_TEMPLATES = (
    ("SELECT * FROM t WHERE note = '", "'"),
    ("SELECT '", "'; DROP TABLE t"),
    ("SELECT * FROM t WHERE note = 'please drop table x ", "'"),
    ("SELECT 1 -- drop ", "\nFROM t /* ; delete */ # update"),
    ("CREATE TEMPORARY VIEW v AS SELECT '", "' AS p"),
    ("create  or replace table t as select '", "'"),
    ("INSERT OVERWRITE t SELECT '", "'"),
    ("MERGE INTO t USING s ON t.p = '", "' WHEN MATCHED THEN DELETE"),
    ("SELECT replace(email, '-', '", "') FROM t"),
    ("GRANT SELECT ON t TO '", "'"),
    ("SELECT * FROM t WHERE c IN ('', '') AND p = '", "'"),
    ("SELECT 'it ", ""),
    ("WITH x AS (SELECT '", "' AS p) DELETE FROM t"),
    ("WITH x AS (SELECT 'a''b; ", "' AS p) INSERT INTO t SELECT * FROM x"),
    ("INSERT INTO t VALUES ('", "');"),
    ("CREATE USER bob -- ", ""),
    ("SELECT * INTO OUTFILE '", "' FROM t"),
    ("SELECT `a FROM t WHERE p = '", "'"),
    ("", ""),
    ("-- ", ""),
    ("'--'; select \"", "\" "),
    ("EXPLAIN SELECT 'it\\'s ", "' ; ; "),
    ("WITH x AS (SELECT r'\\' AS p, '", "' AS q) INSERT OVERWRITE t SELECT concat(p, 'y') FROM x"),
    ("WITH x AS (SELECT '", "' AS p) /* /* */ ' */ INSERT OVERWRITE t SELECT p FROM x --'"),
    ("WITH x AS (SELECT '", "' AS p) --\rINSERT OVERWRITE t SELECT p FROM x"),
    ("SELECT builtin.`Java_Method` ('java.lang.System', 'getProperty', '", "')"),
    ("SELECT count(*) AS n FROM t, csv.`/etc/hosts` WHERE note = '", "'"),
    ("SELECT reflect, t.csv FROM t WHERE note = 'reflect(x) from csv.`a`", "'"),
)


def _statement() -> Column:
    picked = F.lit(None).cast("string")
    texts = [
        F.concat(F.lit(before), F.col("props"), F.lit(after)) if before else F.lit("   ") for before, after in _TEMPLATES
    ]
    which = (F.col("event_id") % len(_TEMPLATES)).cast("int")
    return reduce(lambda rest, i: F.when(which == i, texts[i]).otherwise(rest), range(len(texts)), picked)


def _statements(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", _statement().alias("sql"))


_CASES = " ".join(
    f"WHEN {i} THEN " + (f"{sql_text(before)} || props || {sql_text(after)}" if before else "'   '")
    for i, (before, after) in enumerate(_TEMPLATES)
)
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_STATEMENTS_SQL = f"""
WITH statements AS (SELECT event_id, user_id, ts, CASE event_id % {len(_TEMPLATES)} {_CASES} END AS sql FROM events)"""
# Literals and comments, verbs and empty literals, as on the other side.
_STRIPPED = r"""trim(regexp_replace(regexp_replace(sql,
    '\b[rR]''[^'']*''|''(?:[^''\\]|\\[\s\S])*''|"(?:[^"\\]|\\[\s\S])*"|/\*[\s\S]*?\*/|--(?:[^\r\n\\]|\\\n|\\)*|#[^\r\n]*', ' ', 'g'), '\s+', ' ', 'g'))"""
_VERBS = "drop delete truncate alter update rename replace grant revoke merge copy vacuum optimize insert".split()
_HIDDEN = " ".join(f"WHEN regexp_matches(s, '(?i)\\b{v}\\b\\s*([^\\s(]|$)') THEN '{v}'" for v in _VERBS)
# Functions that run code and formats of files, as on the other side.
_RUNNING, _FORMATS = "java_method|reflect|try_reflect|identifier", "avro|binaryfile|csv|delta|image|json|libsvm|orc|parquet|text|xml"
_JUDGED_SQL = f"""
parts AS (SELECT *, regexp_matches(sql, '/\\*[^*]*/\\*') AS unfollowed, [trim(x) for x in string_split({_STRIPPED}, ';') if trim(x) <> ''] AS list FROM statements),
single AS (SELECT *, len(list) AS n, coalesce(list[1], '') AS s FROM parts),
verbs AS (SELECT *, lower(regexp_extract(s, '(?i)^[a-z_]+')) AS verb FROM single),
kinds AS (SELECT *, CASE
    WHEN n <> 1 THEN 'unknown'
    WHEN verb IN ({", ".join(f"'{v}'" for v in _VERBS if v != "insert")}) THEN 'destructive'
    WHEN verb = 'create' AND regexp_matches(s, '(?i)^create\\s+or\\s+replace\\b') THEN 'destructive'
    WHEN verb = 'create' AND regexp_matches(s, '(?i)^create\\s+(temporary\\s+)?(catalog|schema|database|table|index|view)\\b') THEN 'create'
    WHEN verb = 'insert' THEN CASE WHEN regexp_matches(s, '(?i)^insert\\s+overwrite\\b') THEN 'destructive' ELSE 'create' END
    WHEN verb IN ('select', 'show', 'describe', 'desc', 'explain', 'with', 'use') THEN 'read'
    ELSE 'unknown' END AS raw_kind, CASE {_HIDDEN} END AS verb_inside FROM verbs),
hidden AS (SELECT *, CASE WHEN raw_kind = 'read' THEN verb_inside END AS smuggled,
    raw_kind = 'read' AND regexp_matches(s, '(?i)\\binto\\s+(outfile|dumpfile)\\b') AS to_file,
    nullif(lower(regexp_extract(s, '(?i)\\b({_RUNNING})`?\\s*\\(', 1)), '') AS running,
    regexp_matches(s, '(?i)(\\b(from|join|into|table|describe|desc)\\s+|,\\s*)`?({_FORMATS})`?\\s*\\.\\s*`|`[^`]*/[^`]*`') AS by_path
    FROM kinds),
judged AS (SELECT *, CASE WHEN unfollowed OR (raw_kind <> 'unknown' AND smuggled IS NULL AND NOT to_file AND (running IS NOT NULL OR by_path))
    THEN 'unknown' WHEN smuggled IS NOT NULL OR to_file THEN 'destructive' ELSE raw_kind END AS kind, CASE
    WHEN trim(sql) = '' THEN 'empty SQL'
    WHEN unfollowed THEN 'comments or names that may hide code'
    WHEN n = 0 THEN 'no executable statement'
    WHEN n > 1 THEN n || ' statements at once; send one'
    WHEN raw_kind = 'unknown' THEN 'unrecognised statement type: "' || verb || '"'
    WHEN smuggled IS NOT NULL THEN 'read statement contains "' || upper(smuggled) || '"'
    WHEN to_file THEN 'read statement writes to a file'
    WHEN running IS NOT NULL THEN 'statement calls "' || running || '"'
    WHEN by_path THEN 'statement names a file as a table' ELSE '' END AS reason FROM hidden)"""
_DEGENERATE = r"""CASE WHEN trim(sql) = '' THEN 'empty SQL'
    WHEN regexp_matches(sql, '(?i)(?:\bIN\s*\(|=\s*|,\s*)''''(?:\s*[,)]|\s*$)') THEN 'contains empty string literals'
    WHEN (length(sql) - length(replace(sql, '`', ''))) % 2 <> 0 THEN 'unbalanced backticks'
    WHEN (length(sql) - length(replace(sql, '''', ''))) % 2 <> 0 THEN 'unbalanced single quotes' END"""


def _strip(spark, sf):
    return _statements(spark, sf).select("event_id", strip_literals(F.col("sql")).alias("stripped"))


def _classify(spark, sf):
    return classify_statements(_statements(spark, sf), "sql").drop("user_id", "ts")


def _degenerate(spark, sf):
    return degenerate_sql(_statements(spark, sf), "sql").select(
        "event_id", F.coalesce("degenerate", F.lit("-")).alias("degenerate")
    )


def _replies(spark, sf) -> DataFrame:
    """Statements as a model replies with them: some bare, some fenced with prose, some no JSON at all."""
    body = F.to_json(F.struct(F.col("sql"), F.col("props").alias("explanation")))
    events = table(spark, sf, "events").select("event_id", "user_id", "props", _statement().alias("sql"))
    reply = (
        F.when(F.col("user_id") % 5 == 0, body)
        .when(F.col("user_id") % 5 == 1, F.concat(F.lit("Sorry, no query for "), F.col("event_id").cast("string")))
        .when(F.col("user_id") % 5 == 2, F.to_json(F.struct(F.lit("").alias("sql"), F.col("props").alias("explanation"))))
        .otherwise(F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\n")))
    )
    return events.select("event_id", reply.alias("reply"))


def _review(spark, sf):
    return review_replies(_replies(spark, sf), "reply").drop("reply")


_REVIEW_SQL = f"""
{_STATEMENTS_SQL}, {_JUDGED_SQL},
replied AS (SELECT j.*, e.props, j.user_id % 5 AS shape, {_DEGENERATE.replace("sql", "j.sql")} AS bad
            FROM judged j JOIN events e USING (event_id)),
readable AS (SELECT *, shape NOT IN (1, 2) AND bad IS NULL AS readable FROM replied)
SELECT event_id, readable AND reason = '' AS ok, CASE WHEN readable THEN kind ELSE 'unknown' END AS kind,
       CASE WHEN shape = 1 THEN 'reply is not JSON' WHEN shape = 2 THEN props
            WHEN bad IS NOT NULL THEN 'malformed SQL: ' || bad ELSE reason END AS reason,
       CASE WHEN shape IN (1, 2) THEN ''
            ELSE regexp_replace(trim(sql, {_BLANKS}), ';+\\s*$', '') END AS sql,
       CASE WHEN shape = 1 THEN '' ELSE props END AS explanation,
       readable AND reason = '' AND kind = 'destructive' AS needs_confirmation
FROM readable"""


def _rollup(spark, sf):
    return audit_rollup(classify_statements(_statements(spark, sf), "sql"), "user_id", "ts")


CHECKS = {
    "strip_literals": Check(_strip, f"{_STATEMENTS_SQL} SELECT event_id, {_STRIPPED} AS stripped FROM statements"),
    "classify_statements": Check(
        _classify,
        f"""{_STATEMENTS_SQL}, {_JUDGED_SQL} SELECT event_id, sql, reason = '' AS ok, kind, reason,
            kind = 'destructive' AS needs_confirmation, kind <> 'read' AS needs_write FROM judged""",
    ),
    "degenerate_sql": Check(
        _degenerate, f"{_STATEMENTS_SQL} SELECT event_id, coalesce({_DEGENERATE}, '-') AS degenerate FROM statements"
    ),
    "review_replies": Check(_review, _REVIEW_SQL),
    "audit_rollup": Check(
        _rollup,
        f"""{_STATEMENTS_SQL}, {_JUDGED_SQL} SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, kind,
            count(*) AS n_statements, count(*) FILTER (reason <> '') AS n_refused FROM judged GROUP BY 1, 2, 3""",
    ),
}
