"""Run registered queries next to their SQL twins: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and not math.isfinite(value):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)
    return names, body


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    names, got = _table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    sql_names, want = _table([d[0] for d in cursor.description], cursor.fetchall())
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {list(set(got) ^ set(want))[:4]}"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"{a} != {b}"
    return None


def main(argv: list[str]) -> int:
    from loomgraph.session import build_session

    import __spark_entry__ as contract

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    wanted = argv[1:]
    for name, fn in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        sql = contract.oracle_sql().get(name)
        try:
            if sql is None:
                df = fn(spark, sf_dir)
                note = f"rows only: {df.count()}"
            else:
                note = compare(spark, con, fn, sql, sf_dir)
                bad += note is not None
        except Exception as error:  # noqa: BLE001 - report and go on
            note = f"ERROR {str(error)[:1500]}"
            bad += 1
        print(f"{name:36s} {time.time() - start:6.1f}s {note or 'ok'}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
