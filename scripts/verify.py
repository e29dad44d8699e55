"""Run registered queries against their SQL on DuckDB and report differences and times.

usage: python scripts/verify.py [--sf DIR] [--cpus N] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from palimpsest.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if value is None:
        return "∅"
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(name: str, query, sql: str | None, spark, folder: str, connection) -> tuple[str, float, float, int]:
    began = time.time()
    frame = query(spark, folder)
    got = [tuple(r) for r in frame.collect()]
    spent = time.time() - began
    if sql is None:
        return "rows-only", spent, 0.0, len(got)
    began = time.time()
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = cursor.fetchall()
    sql_spent = time.time() - began
    if sorted(names) != sorted(frame.columns):
        return f"COLUMNS {sorted(frame.columns)} vs {sorted(names)}", spent, sql_spent, len(got)
    a, b = rows_of(frame.columns, got), rows_of(names, wanted)
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}", spent, sql_spent, len(got)
    if a != b:
        at = next(i for i in range(len(a)) if a[i] != b[i])
        return f"VALUES {str(a[at])[:300]}\n    vs {str(b[at])[:300]}", spent, sql_spent, len(got)
    return "ok", spent, sql_spent, len(got)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--cpus", default="8")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    from palimpsest.checks import ORACLES, QUERIES

    spark = local_session(options.cpus, "verify")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(options.sf)
    failed = 0
    for name, query in QUERIES.items():
        if options.names and not any(part in name for part in options.names):
            continue
        try:
            verdict, spent, sql_spent, rows = compare(name, query, ORACLES.get(name), spark, options.sf, connection)
        except Exception as error:
            verdict, spent, sql_spent, rows = f"ERROR {type(error).__name__} {str(error)[:1200]}", 0.0, 0.0, -1
        if verdict not in ("ok", "rows-only"):
            failed += 1
        empty = "  EMPTY" if rows == 0 else ""
        print(f"{name:38s} {spent:6.2f}s sql {sql_spent:6.2f}s {rows:8d} {verdict}{empty}", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
