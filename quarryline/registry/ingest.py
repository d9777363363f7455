"""Queries for reading, typing and loading (A1-A16)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import to_rectangular
from ..operators.infer import cast_typed, collect_types, infer_types, remember_states, remembered_types, ungroup_number
from ..session import workspace
from ..sources.csv import drop_empty_rows, export_snapshot, scan_csv
from ..sources.generate import Field, synthetic_rows
from ..sources.payloads import page_warnings, stitch_pages, unnest_json_tables
from ..sources.tables import load_bronze, load_flat, open_schema
from ..sources.uploads import label_source, plan_uploads
from ..streaming.drops import stream_bronze
from .base import Check, table


def new_schema(spark: SparkSession, label: str) -> str:
    """A schema of its own for one run, its tables kept in the shared workspace."""
    return open_schema(spark, f"{label}_{uuid.uuid4().hex}", workspace(spark, label))


def _csv_roundtrip(spark, sf):
    path = workspace(spark, "csv")
    export_snapshot(table(spark, sf, "orders"), path)
    text = scan_csv(spark, path)
    typed = cast_typed(text, collect_types(infer_types(text)))
    # Key columns infer as INT or BIGINT depending on how large the table is.
    return typed.withColumns({c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")})


def _drop_empty(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_totalprice") >= 250000, F.col("o_totalprice")).alias("price"),
    )
    return drop_empty_rows(rows, ["status", "price"]).select(
        "o_orderkey", F.coalesce("status", F.lit("-")).alias("status"), F.coalesce("price", F.lit(0.0)).alias("price")
    )


# Text columns of every inferable type: name, as a Spark expression, as a DuckDB expression.
_TEXT_COLUMNS = (
    ("small_key", "cast(l_linenumber as string)", "CAST(l_linenumber AS VARCHAR)"),
    ("big_key", "cast(l_orderkey * 100000000 + 1 as string)", "CAST(l_orderkey * 100000000 + 1 AS VARCHAR)"),
    ("price", "cast(l_extendedprice as string)", "CAST(l_extendedprice AS VARCHAR)"),
    ("grouped", "format_number(l_partkey * 1000, 0)", "format('{:,}', l_partkey * 1000)"),
    ("returned", "if(l_returnflag = 'R', 'TRUE', 'false')", "CASE WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'false' END"),
    ("shipped_at", "date_format(l_shipdate, 'yyyy-MM-dd HH:mm')", "strftime(l_shipdate, '%Y-%m-%d %H:%M')"),
    ("shipped_on", "date_format(l_shipdate, 'yyyy-MM-dd')", "strftime(l_shipdate, '%Y-%m-%d')"),
    (
        "mixed_dates",
        "date_format(l_shipdate, if(l_linenumber = 1, 'yyyy-MM-dd', 'yyyy-MM-dd HH:mm'))",
        "CASE WHEN l_linenumber = 1 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M') END",
    ),
    ("flag", "if(l_linestatus = 'O', l_returnflag, '')", "CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE '' END"),
    ("padded", "concat(' ', l_linenumber)", "' ' || l_linenumber"),
    ("nothing", "''", "''"),
    ("long_text", "repeat(l_returnflag, l_linenumber * 150)", "repeat(l_returnflag, l_linenumber * 150)"),
)


def _text_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(*[F.expr(e).alias(name) for name, e, _ in _TEXT_COLUMNS])


def _infer_in_parts(spark, sf) -> DataFrame:
    """Seven parts of the table looked at one after the other, their states kept, and types of the whole from these."""
    folder, lines = workspace(spark, "states"), table(spark, sf, "lineitem")
    for part in range(1, 8):
        texts = lines.filter(F.col("l_linenumber") == part).select(*[F.expr(e).alias(name) for name, e, _ in _TEXT_COLUMNS])
        remember_states(texts, folder, f"part {part}")
    return remembered_types(spark, folder)


def _infer_sql(position: int, name: str, expression: str) -> str:
    return f"""
SELECT {position} AS position, '{name}' AS "column", inferred,
       CASE WHEN inferred LIKE 'VARCHAR%' OR inferred = 'TEXT' THEN 'string'
            WHEN inferred = 'DATETIME' THEN 'timestamp_ntz' ELSE lower(inferred) END AS spark_type,
       longest, n_present
FROM (SELECT CASE WHEN n_present = 0 THEN 'TEXT'
                  WHEN all_int THEN CASE WHEN any_big THEN 'BIGINT' ELSE 'INT' END
                  WHEN all_num THEN 'DOUBLE'
                  WHEN all_bool THEN 'BOOLEAN' WHEN all_moment THEN 'DATETIME' WHEN all_day THEN 'DATE'
                  WHEN longest > 1000 THEN 'TEXT'
                  ELSE 'VARCHAR(' || least(greatest(longest * 2, 32), 1000) || ')' END AS inferred,
             longest, n_present
      FROM (SELECT count(v) AS n_present, CAST(coalesce(max(length(v)), 0) AS INTEGER) AS longest,
                   bool_and(regexp_full_match(p, '-?\\d+')) AS all_int,
                   bool_or(abs(try_cast(p AS DOUBLE)) > 2147483647) AS any_big,
                   bool_and(regexp_full_match(p, '-?\\d+(\\.\\d+)?')) AS all_num,
                   bool_and(regexp_full_match(v, '(?i)true|false')) AS all_bool,
                   bool_and(regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}[ T]\\d{{2}}:\\d{{2}}(:\\d{{2}})?')) AS all_moment,
                   bool_and(regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS all_day
            FROM (SELECT v, CASE WHEN regexp_full_match(v, '-?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?')
                                 THEN replace(v, ',', '') ELSE v END AS p
                  FROM (SELECT nullif({expression}, '') AS v FROM lineitem))))"""


_INFER_SQL = " UNION ALL ".join(_infer_sql(i, name, sql) for i, (name, _, sql) in enumerate(_TEXT_COLUMNS))


def _grouped_numbers(spark, sf):
    number = F.col("event_id") * 7919 - 50000
    text = F.format_number(number, 0)
    return table(spark, sf, "events").select(
        "event_id", text.alias("written"), ungroup_number(text).try_cast("bigint").alias("number")
    )


_GROUPED_SQL = """
SELECT event_id, format('{:,}', event_id * 7919 - 50000) AS written, event_id * 7919 - 50000 AS number FROM events"""


def _bronze_lineage(spark, sf):
    name = f"{new_schema(spark, 'bronze')}.parties"
    customers = table(spark, sf, "customer").toDF("party", "party_name", "nation", "balance", "segment")
    suppliers = table(spark, sf, "supplier").toDF("party", "party_name", "nation", "balance")
    load_bronze(customers, name, "customers.csv")
    bronze = load_bronze(suppliers, name, "suppliers.csv", mode="append")
    return bronze.select(
        "party", "party_name", "nation", "balance", F.coalesce("segment", F.lit("-")).alias("segment"),
        "_source", F.col("_ingested_at").isNotNull().alias("dated"),
    )


_BRONZE_SQL = """
SELECT c_custkey AS party, c_name AS party_name, c_nationkey AS nation, c_acctbal AS balance,
       c_mktsegment AS segment, 'customers.csv' AS _source, true AS dated FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, '-', 'suppliers.csv', true FROM supplier"""


def _flat_append(spark, sf):
    name = f"{new_schema(spark, 'flat')}.parties"
    load_flat(table(spark, sf, "customer").toDF("party", "party_name", "nation", "balance", "segment"), name)
    added, total = load_flat(
        table(spark, sf, "supplier").toDF("party", "party_name", "nation", "balance"), name, mode="append"
    )
    return spark.table(name).select(
        "party", "party_name", "nation", "balance", F.coalesce("segment", F.lit("-")).alias("segment"),
        F.lit(added).cast("bigint").alias("rows_inserted"), F.lit(total).cast("bigint").alias("total_rows"),
    )


_FLAT_SQL = """
SELECT p.*, (SELECT count(*) FROM supplier) AS rows_inserted,
       (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS total_rows
FROM (SELECT c_custkey AS party, c_name AS party_name, c_nationkey AS nation, c_acctbal AS balance,
             c_mktsegment AS segment FROM customer
      UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, '-' FROM supplier) p"""


def _file_name() -> Column:
    site = F.regexp_replace("url", r"^https?://([^/]*).*$", "$1")
    return (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("2026_q3_export_"), site, F.lit("_v2.csv")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("20260701_"), site, F.lit("_latest.CSV")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("Report-"), F.col("url"), F.lit("_final.pdf")))
        .otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".csv")))
        .alias("file_name")
    )


def _plan_uploads(spark, sf):
    files = table(spark, sf, "pages").select("page_id", _file_name())
    return plan_uploads(files).select("page_id", "file_name", "table_name", "n_files", "clash")


_UPLOADS_SQL = r"""
WITH files AS (
  SELECT page_id, CASE page_id % 4
    WHEN 0 THEN '2026_q3_export_' || site || '_v2.csv' WHEN 1 THEN '20260701_' || site || '_latest.CSV'
    WHEN 2 THEN 'Report-' || url || '_final.pdf' ELSE page_id || '.csv' END AS file_name
  FROM (SELECT page_id, url, regexp_replace(url, '^https?://([^/]*).*$', '\1') AS site FROM pages)),
a AS (SELECT *, regexp_replace(regexp_replace(lower(file_name), '\.(csv|pdf)$', ''), '[^a-z0-9]+', '_', 'g') AS n FROM files),
b AS (SELECT *, regexp_replace(regexp_replace(n, '^([0-9]{4,8}|[0-9]{4}_?q[1-4]|[0-9]{2}_[0-9]{2}_[0-9]{2,4})_', ''),
                '^(export|extract|report|copy_of|final|raw|data|dump)_', '') AS n2 FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(n2, '_(export|extract|final|raw|copy|latest|[0-9]{4,8})$', ''),
                '_v[0-9]+$', '') AS n3 FROM b),
d AS (SELECT *, regexp_replace(regexp_replace(n3, '_{2,}', '_', 'g'), '^_+|_+$', '', 'g') AS n4 FROM c),
e AS (SELECT page_id, file_name,
        CASE WHEN n4 = '' OR regexp_matches(n4, '^[0-9]') THEN 'my_table' ELSE left(n4, 40) END AS table_name FROM d)
SELECT page_id, file_name, table_name, count(*) OVER (PARTITION BY table_name) AS n_files,
       count(*) OVER (PARTITION BY table_name) > 1 AS clash FROM e"""


def _scanned(spark, sf) -> DataFrame:
    """Conversations read as scanned documents: a turn is a page, its lines are rows, words are cells.

    A page starts its columns with the words of its first line; system turns hold no table.
    """
    lines = F.split("text", "\n")
    no_columns = F.array().cast("array<string>")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("page"),
        F.when(F.col("role") == "system", no_columns).otherwise(F.split(lines[0], " ")).alias("columns"),
        F.transform(lines, lambda line: F.split(line, " ")).alias("rows"),
    )


def _stitch_pages(spark, sf):
    return stitch_pages(_scanned(spark, sf)).select(
        "doc_id", "page", "row_no", F.array_join("columns", "|").alias("header"), F.array_join("cells", "|").alias("cells")
    )


_SCANNED_SQL = r"""
WITH scanned AS (
  SELECT conv_id AS doc_id, turn AS page, string_split(text, chr(10)) AS lines,
         CASE WHEN role = 'system' THEN [] ELSE string_split(string_split(text, chr(10))[1], ' ') END AS columns
  FROM conversations),
headers AS (SELECT doc_id, arg_min(columns, page) AS header FROM scanned WHERE len(columns) > 0 GROUP BY doc_id)"""
_STITCH_SQL = (
    _SCANNED_SQL
    + r"""
SELECT doc_id, page, CAST(i - 1 AS INTEGER) AS row_no, array_to_string(header, '|') AS header,
       array_to_string([coalesce(cells[j], '') for j in range(1, len(header) + 1)], '|') AS cells
FROM (SELECT s.doc_id, s.page, h.header, i, string_split(s.lines[i], ' ') AS cells
      FROM scanned s JOIN headers h USING (doc_id), unnest(range(1, len(s.lines) + 1)) AS u(i))"""
)


def _page_warnings(spark, sf):
    return page_warnings(_scanned(spark, sf))


_WARNINGS_SQL = (
    _SCANNED_SQL
    + """,
firsts AS (SELECT doc_id, min(page) AS first_page FROM scanned GROUP BY doc_id)
SELECT doc_id, page, format('page {} had {} columns vs {}', page, len(columns), len(header)) AS warning
FROM scanned JOIN headers USING (doc_id) JOIN firsts USING (doc_id)
WHERE len(columns) > 0 AND page > first_page AND len(columns) <> len(header)
UNION ALL
SELECT doc_id, 0, 'no table found on any page' FROM firsts WHERE doc_id NOT IN (SELECT doc_id FROM headers)"""
)


def _payload() -> Column:
    """Documents as a model would send them: lines numbered in a table, fenced, with prose around.

    Blank lines make rows too short, the others rows too long.
    """
    rows = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(line == "", F.array(i.cast("string"))).otherwise(
            F.array(i.cast("string"), line, F.lit("left over"))
        ),
    )
    body = F.to_json(F.struct(F.array(F.lit(" line "), F.lit("text")).alias("columns"), rows.alias("rows")))
    return F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nAnything else?")).alias("payload")


def _unnest_json(spark, sf):
    documents = table(spark, sf, "documents")
    broken = F.when(F.col("doc_id") % 10 == 3, F.lit("I could not find a table.")).when(
        F.col("doc_id") % 10 == 7, F.lit('{"columns": [], "rows": []}')
    )
    without = documents.select((-1 - F.col("doc_id")).alias("doc_id"), broken.alias("payload")).filter("payload IS NOT NULL")
    payloads = documents.select("doc_id", _payload()).unionByName(without)
    rows = unnest_json_tables(payloads, "payload", ["doc_id"])
    named = to_rectangular(rows, ["line", "text"], keep=("doc_id", "status", "row_no"))
    return named.select(
        "doc_id", "status", F.coalesce("row_no", F.lit(-1)).alias("row_no"),
        F.coalesce("line", F.lit("-")).alias("line"), F.coalesce("text", F.lit("-")).alias("text"),
    )


_UNNEST_SQL = """
SELECT doc_id, 'ok' AS status, CAST(i - 1 AS INTEGER) AS row_no, CAST(i - 1 AS VARCHAR) AS line,
       replace(replace(string_split(text, chr(10))[i], '```json', ''), '```', '') AS text
FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
UNION ALL
SELECT -1 - doc_id, CASE doc_id % 10 WHEN 3 THEN 'not json' ELSE 'no tabular data' END, -1, '-', '-'
FROM documents WHERE doc_id % 10 IN (3, 7)"""

_FIELDS = [
    Field("plan", "choice", choices=("free", "team", "company")),
    Field("seats", "number", low=1, high=50),
    Field("fee", "amount", low=100, high=99999),
    Field("joined", "day", low=0, high=364, start="2026-01-01"),
]


def _synthetic(spark, sf):
    requests = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey")).alias("wanted")
    )
    return synthetic_rows(requests, _FIELDS, "c_custkey", "wanted").withColumn(
        "joined", F.col("joined").cast("timestamp_ntz")
    )


_SYNTHETIC_SQL = """
SELECT c_custkey, row_no, ['free', 'team', 'company'][(c_custkey * 31 + row_no * 17) % 3 + 1] AS plan,
       (c_custkey * 31 + row_no * 17 + 7) % 50 + 1 AS seats,
       round(((c_custkey * 31 + row_no * 17 + 14) % 99900 + 100) / 100.0, 2) AS fee,
       TIMESTAMP '2026-01-01' + to_days(CAST((c_custkey * 31 + row_no * 17 + 21) % 365 AS INTEGER)) AS joined
FROM customer, unnest(range(CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_nationkey ELSE 20 END)) AS u(row_no)"""


def _label_source(spark, sf):
    return label_source(table(spark, sf, "documents"), "text").select("doc_id", "source_label")


_WORDS_SQL = {
    "invented": r"\b(fake|synthetic|dummy|sample|mock|random|test data|made[- ]?up|placeholder|generate \d+ (fake|random))\b",
    "real": r"\b(real|actual|current|latest|today|this year|202\d|statistics|stats"
    r"|by (gdp|population|country|region)|top \d+ countries|official)\b",
}
_LABEL_SQL = f"""
SELECT doc_id, CASE WHEN invented AND NOT really THEN 'synthetic' WHEN really AND NOT invented THEN 'real'
               ELSE 'ask' END AS source_label
FROM (SELECT doc_id, regexp_matches(lower(text), '{_WORDS_SQL["invented"]}') AS invented,
             regexp_matches(lower(text), '{_WORDS_SQL["real"]}') AS really FROM documents)"""


def _label_requests(spark, sf):
    """Requests that name kinds of data, so that every label occurs."""
    kinds = F.array(*map(F.lit, ("Fake", "the latest", "some", "random official")))
    kind = F.element_at(kinds, (F.col("user_id") % 4 + 1).cast("int"))
    said = F.concat_ws(" ", kind, "event_type", F.lit("figures"), "props").alias("request")
    return label_source(table(spark, sf, "events").select("event_id", said), "request")


_REQUESTS_SQL = """
SELECT event_id, ['Fake', 'the latest', 'some', 'random official'][user_id % 4 + 1] || ' ' || event_type
         || ' figures ' || props AS request,
       ['synthetic', 'real', 'ask', 'ask'][user_id % 4 + 1] AS source_label FROM events"""


def _stream_bronze(spark, sf):
    root = workspace(spark, "stream")
    export_snapshot(table(spark, sf, "events"), f"{root}/drop")
    types = {
        "event_id": "BIGINT", "ts": "DATETIME", "user_id": "BIGINT",
        "event_type": "VARCHAR(32)", "value": "DOUBLE", "props": "VARCHAR(32)",
    }
    for _ in range(2):  # the second run finds nothing new
        stream_bronze(spark, f"{root}/drop", types, f"{root}/bronze", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/bronze").select(
        *types, F.col("_source").endswith(".csv").alias("from_csv"), F.col("_ingested_at").isNotNull().alias("dated")
    )


_STREAM_SQL = """
SELECT event_id, date_trunc('second', ts) AS ts, user_id, event_type, value, props, true AS from_csv, true AS dated
FROM events"""

CHECKS = {
    "csv_roundtrip": Check(_csv_roundtrip, "SELECT * FROM orders"),
    "drop_empty_rows": Check(
        _drop_empty,
        """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '-' END AS status,
                  CASE WHEN o_totalprice >= 250000 THEN o_totalprice ELSE 0 END AS price
           FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice >= 250000""",
    ),
    "infer_types": Check(lambda spark, sf: infer_types(_text_lines(spark, sf)), _INFER_SQL),
    "infer_types_in_parts": Check(_infer_in_parts, _INFER_SQL),
    "grouped_numbers": Check(_grouped_numbers, _GROUPED_SQL),
    "bronze_lineage": Check(_bronze_lineage, _BRONZE_SQL),
    "flat_append": Check(_flat_append, _FLAT_SQL),
    "plan_uploads": Check(_plan_uploads, _UPLOADS_SQL),
    "stitch_pages": Check(_stitch_pages, _STITCH_SQL),
    "page_warnings": Check(_page_warnings, _WARNINGS_SQL),
    "unnest_json_tables": Check(_unnest_json, _UNNEST_SQL),
    "synthetic_rows": Check(_synthetic, _SYNTHETIC_SQL),
    "label_source": Check(_label_source, _LABEL_SQL),
    "label_requests": Check(_label_requests, _REQUESTS_SQL),
    "stream_bronze": Check(_stream_bronze, _STREAM_SQL),
}
