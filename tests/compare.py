"""Compare the registered queries with their SQL: `python tests/compare.py [sf] [query ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(cell(row[i]) for i in order) for row in rows])


def differences(df, con, sql):
    """Empty when the DataFrame and the SQL give the same columns and the same rows."""
    relation = con.sql(sql)
    left = table(df.columns, df.collect())
    right = table(relation.columns, relation.fetchall())
    if left[0] != right[0]:
        return [f"columns {left[0]} != {right[0]}"]
    if len(left[1]) != len(right[1]):
        return [f"{len(left[1])} rows != {len(right[1])}", str(left[1][:2]), str(right[1][:2])]
    return [f"{a} != {b}" for a, b in zip(left[1], right[1]) if a != b][:5]


def main():
    from cohortpref.plans.catalog import QUERIES
    from cohortpref.plans.oracle import SQL
    from cohortpref.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            result = differences(df, con, SQL[name]) if name in SQL else [f"(no SQL) {len(df.collect())} rows"]
        except Exception as error:  # report and go on with the next query
            result = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed = bool(result) and not result[0].startswith("(no SQL)")
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {name:32s} {time.time() - start:6.2f}s", *result, flush=True)
    print(f"{bad} failures of {len(names)}")


if __name__ == "__main__":
    main()
