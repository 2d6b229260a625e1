"""Runs a query and its SQL side by side: ``python tests/oracle.py [sf_dir] [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value.isoformat() if hasattr(value, "isoformat") else str(value) if isinstance(value, bytes | list | dict) else value


def canonical(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows in an order that both sides share."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(found, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def from_sql(sf_dir: str, sql: str) -> tuple[list[str], list]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def difference(df, sf_dir: str, sql: str) -> str:
    """Empty if both give the same."""
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    theirs = canonical(*from_sql(sf_dir, sql))
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if mine[1] == theirs[1]:
        return ""
    only = [r for r in mine[1] if r not in theirs[1]][:2], [r for r in theirs[1] if r not in mine[1]][:2]
    return f"rows {len(mine[1])} and {len(theirs[1])}; only here {only[0]}, only there {only[1]}"


def main(args: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args[1:] or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            said = difference(df, sf_dir, sql[name]) or "ok" if name in sql else f"{df.count()} rows, no SQL"
        except Exception as e:
            said = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
