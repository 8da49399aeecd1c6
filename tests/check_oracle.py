"""Run queries next to their SQL: ``python tests/check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows-only {len(got)}"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}"
    if repr(got) == repr(want):
        return f"ok {len(got)}" if got else "EMPTY"
    diff = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)][:2]
    return f"DIFF rows {len(got)} vs {len(want)}: {sorted(columns)} {diff}"


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main():
    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry
    from tarnfield.runtime import local_session

    if os.environ.get("PLAIN"):  # a session as a stranger would make it
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8)
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            result = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as error:  # report and go on
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if not result.startswith(("ok", "rows-only")):
            bad += 1
        if not (os.environ.get("QUIET") and result.startswith("ok")):
            print(f"{name:40s} {time.time() - start:6.2f}s {result}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
