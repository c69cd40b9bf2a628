"""Compares queries with their SQL in DuckDB: python tests/oracle.py [--sf DIR] NAME..."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    if x is None:
        return "null"
    return str(x)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[n]) for n in names) for r in df.collect())


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rel.fetchall())


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    args, sf = sys.argv[1:], "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    q, o, bad = entry.queries(), entry.oracle_sql(), 0
    for name in args or list(q):
        t = time.time()
        try:
            a = spark_rows(q[name](spark, sf))
            if name in o:
                b = duck_rows(o[name], sf)
                same = a == b
                diff = "" if same else f" columns {a[0]} / {b[0]} rows {len(a[1])} / {len(b[1])} first {[x for x in zip(a[1], b[1]) if x[0] != x[1]][:2]}"
                print("same" if same else "DIFFERENT", name, len(a[1]), f"{time.time() - t:.1f}s", diff[:1500], flush=True)
                bad += not same
            else:
                print("rows", name, len(a[1]), f"{time.time() - t:.1f}s", a[0], a[1][:2], flush=True)
        except Exception as e:
            bad += 1
            print("ERROR", name, f"{type(e).__name__}: {str(e)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
