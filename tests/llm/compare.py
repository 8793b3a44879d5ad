"""Compare a registered query of this subpackage with its SQL twin: ``python -m tests.llm.compare op10_exact_dedup``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

from tests.check_oracle import TABLES, digest, kind, rows_by_name


def compare(spark, name: str, folder: str) -> str:
    from tidegate.llm import queries  # noqa: F401
    from tidegate.llm.registry import ORACLE_SQL, QUERIES

    started = time.time()
    frame = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in frame.collect()]
    spent = time.time() - started
    if name not in ORACLE_SQL:
        return f"ROWS {name}: {len(rows)} rows {spent:.1f}s"
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    started = time.time()
    result = connection.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    notes = [f"{c}:{t}/{types[c]}" for c, t in frame.dtypes if kind(t) != kind(types[c])]
    mine, theirs = rows_by_name(frame.columns, rows), rows_by_name(columns, expected)
    if sorted(columns) != sorted(frame.columns) or digest(mine) != digest(theirs) or notes:
        left, right = set(map(str, mine)), set(map(str, theirs))
        return f"FAIL {name}: {len(mine)} vs {len(theirs)} {notes} {sorted(left - right)[:3]} {sorted(right - left)[:3]}"
    return f"ok {name}: {len(rows)} rows {spent:.1f}s sql {time.time() - started:.1f}s"


def main(names: list[str]) -> int:
    from tests.check_oracle import session
    from tidegate.llm import queries  # noqa: F401
    from tidegate.llm.registry import QUERIES

    spark = session()
    lines = []
    for name in names or list(QUERIES):
        lines.append(compare(spark, name, os.environ.get("SF_DIR", "/root/testdata/sf0.01")))
        print(lines[-1], flush=True)
    return int(any(line.startswith("FAIL") for line in lines))


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
