"""Runs registered queries in Spark and their twins in DuckDB and compares the rows.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from workload.base import TABLES
from workload.registry import ORACLE, QUERIES


TIMES: dict[str, float] = {}


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return float(value)
    return value


def normalise(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when both engines agree, else what differs."""
    start = time.time()
    frame = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in frame.collect()]
    TIMES[name] = time.time() - start
    if name not in ORACLE:
        return None
    result = con.execute(ORACLE[name])
    twin_names = [d[0] for d in result.description]
    twin_rows = result.fetchall()
    if sorted(twin_names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(twin_names)}"
    ours, theirs = normalise(frame.columns, rows), normalise(twin_names, twin_rows)
    if len(ours) != len(theirs):
        extra = [r for r in ours if r not in set(theirs)][:3] if len(ours) < 20000 else []
        missing = [r for r in theirs if r not in set(ours)][:3] if len(ours) < 20000 else []
        return f"rows {len(ours)} != {len(theirs)}; ours only {extra}; twin only {missing}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, {sorted(frame.columns)}: {wrong[:3]}" if wrong else None


def main() -> int:
    from trailgrid.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--types", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = [n for n in QUERIES if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        note = "" if name in ORACLE else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{note} {time.time() - start:.1f}s (spark {TIMES.get(name, -1):.1f}s) {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
