"""Run named queries and compare each with its SQL on DuckDB: ``python tests/check_queries.py [sf] [name-part ...]``."""

from __future__ import annotations

import sys
import threading
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from cityloom.runtime import session
from cityloom.sources.derived import BASE_TABLES


LIMIT_SECONDS = 240


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return int(value)
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns differ: {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    a, b = rows_of(spark_frame), rows_of(sql_frame)
    if len(a) != len(b):
        return f"row counts differ: {len(a)} / {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None


def main(sf: str, parts: list[str]) -> int:
    folder = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        watch = threading.Timer(LIMIT_SECONDS, spark.sparkContext.cancelAllJobs)
        watch.start()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - began
            if name in oracles:
                began = time.time()
                want = con.execute(oracles[name]).df()
                verdict = compare(got, want)
                note = f"{len(got)} rows, spark {took:.1f}s duckdb {time.time() - began:.1f}s"
            else:
                verdict, note = None, f"{len(got)} rows, spark {took:.1f}s, rows only"
        except Exception as problem:  # report and go on with the next query
            verdict, note = f"{type(problem).__name__}: {str(problem)[:900]}", ""
        finally:
            watch.cancel()
        bad += verdict is not None
        print(("ok   " if verdict is None else "BAD  ") + name, note, verdict or "", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(min(1, main(arguments[0] if arguments else "0.01", arguments[1:])))
