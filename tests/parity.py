"""Run a registered query and its SQL side by side and compare names, types and values."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

from passageworks.queries import ORACLES, QUERIES


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, (bool, int, decimal.Decimal, datetime.date, datetime.datetime)):
        return str(value)
    return value if value is None else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, x or "") for x in r]
    )


_KIND = {"long": "BIGINT", "integer": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int]:
    """An empty text when both sides agree, otherwise what differs; and the number of rows."""
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return ("", len(got)) if got else ("no rows", 0)
    rel = con.sql(ORACLES[name])
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}", len(got)
    ours = {f.name: _KIND.get(f.dataType.typeName(), f.dataType.simpleString()) for f in df.schema}
    theirs = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if ours != theirs:
        return f"types {ours} and {theirs}", len(got)
    want = rel.fetchall()
    a, b = _rows(df.columns, got), _rows(rel.columns, want)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}", len(got)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        return f"{len(different)} rows differ, first {str(different[0])[:600]}", len(got)
    return "", len(got)


if __name__ == "__main__":
    from passageworks.session import build_session

    sf_dir = sys.argv[1]
    session = build_session(
        "parity", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                 "spark.driver.memory": "16g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = database(sf_dir)
    failed = 0
    for query_name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            problem, n = compare(session, connection, query_name, sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {query_name} {n} rows {time.time() - start:.1f}s "
              f"{'' if query_name in ORACLES else '[rows only]'} {problem}", flush=True)
    print("failed:", failed)
