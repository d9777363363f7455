"""Runs registered queries next to their SQL and compares the rows.

``python -m tests.oracle [scale factor] [query ...]``
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    mine = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    for a, b in zip(mine, theirs):
        if repr(a) != repr(b):
            return f"{a!r}\n   / {b!r}"[:1500]
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from quarryline.session import local_session

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failures = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if (argv[1:] and name not in argv[1:]) or name not in sqls:
            continue
        start = time.time()
        try:
            difference = compare(run(spark, sf_dir), con, sqls[name])
        except Exception as error:  # report and go on with the others
            difference = f"{type(error).__name__}: {str(error)[:1200]}"
        print(f"{'ok  ' if difference is None else 'FAIL'} {name} {time.time() - start:.2f}s", flush=True)
        if difference:
            failures += 1
            print("   ", difference)
    print(f"{failures} failed")
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
