"""Runs queries beside their SQL in DuckDB over the same tables.

python tests/compare.py [SF] NAME...   (all names with SQL if none is given)
"""

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql: str, sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = c.sql(sql)
    return [x.lower() for x in r.columns], [str(t) for t in r.types], r.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, sf_dir):
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    got = canonical([c.lower() for c in df.columns], [tuple(r) for r in df.collect()])
    columns, types, rows = oracle_rows(e.oracle_sql()[name], sf_dir)
    want = canonical(columns, rows)
    return got, want, df.dtypes, list(zip(columns, types))


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in args or sorted(e.oracle_sql()):
        t = time.time()
        try:
            got, want, kinds, types = compare(spark, name, f"/root/testdata/{sf}")
            ok = got == want
            print("ok  " if ok else "DIFF", name, f"{time.time() - t:.1f}s", len(got[1]), len(want[1]), flush=True)
            if not ok:
                print("  spark", kinds, "\n  duckdb", types)
                a, b = set(map(repr, got[1])), set(map(repr, want[1]))
                print("  only spark", sorted(a - b)[:3], "\n  only duckdb", sorted(b - a)[:3])
            bad += not ok
        except Exception as x:
            bad += 1
            print("FAIL", name, type(x).__name__, str(x)[:600], flush=True)
    sys.exit(bool(bad))
