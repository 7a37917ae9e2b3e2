"""Compare registered queries with their SQL on DuckDB: python tests/check.py [sf] [name ...]."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else f"{number:.6f}".replace("-0.000000", "0.000000")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, build, sql, folder):
    start = time.time()
    df = build(spark, folder)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return f"rows {len(got[1])}", spent, True
    start = time.time()
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    sql_spent = time.time() - start
    if got == want:
        return f"ok {len(got[1])} rows (sql {sql_spent:.1f}s)", spent, True
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", spent, False
    a, b = set(got[1]), set(want[1])
    clip = lambda rows: [str(r)[:300] for r in sorted(rows)[:2]]
    return f"DIFF {len(got[1])} vs {len(want[1])}; spark {clip(a - b)}; sql {clip(b - a)}", spent, False


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from mnemolake.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls = oracle_sql()
    bad = []
    for name, build in queries().items():
        if names and name not in names:
            continue
        try:
            text, spent, ok = compare(spark, con, name, build, sqls.get(name), folder)
        except Exception as error:  # noqa: BLE001
            text, spent, ok = f"ERROR {str(error)[:600]}", 0.0, False
        print(f"{name:28s} {spent:6.1f}s {text}", flush=True)
        if not ok:
            bad.append(name)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
