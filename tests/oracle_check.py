"""Run queries next to their SQL and compare the results.

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, query, sql: str | None, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    frame = query(spark, sf_dir)
    got = frame.collect()
    if sql is None:
        return "" if got else "no rows"
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    left = rows_of(frame.columns, got)
    right = rows_of(columns, result.fetchall())
    if left == right:
        return "" if left else "both empty"
    left_set, right_set = set(left), set(right)
    only_left = [r for r in left if r not in right_set][:2]
    only_right = [r for r in right if r not in left_set][:2]
    short = lambda rows: str(rows)[:700]
    return f"{len(left)} rows against {len(right)}; spark only {short(only_left)}; sql only {short(only_right)}"


def main() -> int:
    from supportlens.plans import catalog
    from supportlens.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    arguments = parser.parse_args()
    sf_dir = f"/root/testdata/sf{arguments.sf}"
    spark = build_session("local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g", spark_ui_enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    failed = 0
    for name in arguments.names or catalog.QUERIES:
        start = time.time()
        try:
            difference = compare(
                spark, connection, catalog.QUERIES[name], catalog.ORACLES.get(name), sf_dir
            )
        except Exception as error:  # report and go on with the next query
            difference = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(difference)
        kind = "sql" if name in catalog.ORACLES else "rows"
        print(f"{'FAIL' if difference else 'ok  '} {kind:4} {time.time() - start:6.2f}s {name} {difference}", flush=True)
    spark.stop()
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
