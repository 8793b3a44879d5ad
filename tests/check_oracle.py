"""Compare registered queries with their SQL twins: ``python tests/check_oracle.py [names]``."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        return repr(round(float(value), 9) + 0.0)
    if hasattr(value, "tolist") and not isinstance(value, str):
        return canonical(value.tolist())
    return str(value)


def digest(rows: list[tuple]) -> str:
    lines = sorted("|".join(canonical(v) for v in row) for row in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


def rows_by_name(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(row[i] for i in order) for row in rows]


def kind(value: str) -> str:
    value = str(value).lower()
    for key, names in {
        "int": ("bigint", "int", "smallint", "tinyint", "integer"),
        "float": ("double", "float"),
        "string": ("varchar", "string"),
        "bool": ("boolean", "bool"),
    }.items():
        if value in names:
            return key
    return value


def compare(spark, name: str, folder: str) -> str:
    from tidegate.catalog.registered import ENTRIES

    item = ENTRIES[name]
    started = time.time()
    frame = item(spark, folder)
    columns = frame.columns
    rows = [tuple(r) for r in frame.collect()]
    spent = time.time() - started
    plan = frame._jdf.queryExecution().executedPlan().toString()
    pairing = [join for join in ("CartesianProduct", "NestedLoopJoin") if join in plan]
    if item.sql is None:
        return f"ROWS  {name}: {len(rows)} rows {spent:.2f}s {' '.join(pairing)}"
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    started = time.time()
    result = connection.execute(item.sql)
    expected_columns = [d[0] for d in result.description]
    types = dict(zip(expected_columns, [str(d[1]) for d in result.description]))
    expected = result.fetchall()
    sql_spent = time.time() - started
    if sorted(columns) != sorted(expected_columns):
        return f"FAIL  {name}: columns {sorted(columns)} != {sorted(expected_columns)}"
    notes = [
        f"{c}:{t}/{types[c]}" for c, t in frame.dtypes if kind(t) != kind(types[c])
    ]
    mine, theirs = rows_by_name(columns, rows), rows_by_name(expected_columns, expected)
    same = digest(mine) == digest(theirs)
    text = f"{len(mine)} rows {spent:.2f}s sql {sql_spent:.2f}s {' '.join(notes + pairing)}"
    if same and not notes:
        return f"ok    {name}: {text}"
    if same:
        return f"TYPES {name}: {text}"
    left = {"|".join(canonical(v) for v in r) for r in mine}
    right = {"|".join(canonical(v) for v in r) for r in theirs}
    show = "\n   spark only: " + "\n               ".join(x[:400] for x in sorted(left - right)[:3])
    show += "\n   sql only:   " + "\n               ".join(x[:400] for x in sorted(right - left)[:3])
    return f"FAIL  {name}: {len(mine)} vs {len(theirs)} rows {text}{show}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(arguments: list[str]) -> int:
    from tidegate.catalog.registered import ENTRIES

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = [n for n in ENTRIES if not arguments or any(n == a or n.startswith(a + "*") or
             (a.endswith("*") and n.startswith(a[:-1])) for a in arguments)]
    modules = [a[1:] for a in arguments if a.startswith("@")]
    if modules:
        names += [n for n, e in ENTRIES.items()
                  if e.build.__module__.rsplit(".", 1)[-1] in modules and n not in names]
    spark = session()
    failed = 0
    for name in names:
        try:
            line = compare(spark, name, folder)
        except Exception as exc:  # noqa: BLE001
            line = f"ERROR {name}: {type(exc).__name__} {str(exc)[:900]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += not line.startswith(("ok", "ROWS"))
        print(line, flush=True)
    print(f"{len(names)} checked, {failed} not ok")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
