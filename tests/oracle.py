"""Runs registered queries against their SQL statement in DuckDB and reports differences.

Usage: python -m tests.oracle [--sf 0.01 | --dir folder] [name or prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tallyworks.sources.schemas import STAR_TABLES

DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in STAR_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0 if value else 0.0)
    return repr(value)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[str | None, int]:
    """(first difference or None, row count)."""
    result = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    names = list(want_types)
    got_types = {f.name: DUCK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    got = [tuple(r) for r in df.collect()]
    if sorted(got_types) != sorted(want_types):
        return f"columns {sorted(got_types)} != {sorted(want_types)}", len(got)
    wrong = {n: (got_types[n], want_types[n]) for n in names if "[" not in want_types[n] and got_types[n] != want_types[n]}
    if wrong:
        return f"types (spark, duckdb) {wrong}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    a, b = _rows(df.columns, got), _rows(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, columns {sorted(names)}\n    spark  {bad[0][0]}\n    duckdb {bad[0][1]}", len(got)
    return None, len(got)


def main(argv: list[str]) -> int:
    from tallyworks.catalog import registered
    from tallyworks.session import local_session

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    folder = f"/root/testdata/sf{sf}"
    if "--dir" in argv:
        at = argv.index("--dir")
        folder = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    queries, sql = registered()
    names = [n for n in queries if not argv or any(n == a or n.startswith(a) for a in argv)]
    spark, con, failed = local_session(), connect(folder), 0
    for name in names:
        began = time.time()
        try:
            if name in sql:
                problem, rows = compare(queries[name](spark, folder), con, sql[name])
            else:
                problem, rows = None, queries[name](spark, folder).count()
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:1200]}", 0
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} rows={rows} {time.time() - began:.1f}s{'' if name in sql else ' (rows only)'}", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print(f"{len(names) - failed} of {len(names)} match")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
