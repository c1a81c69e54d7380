"""Run registered queries and compare them with their oracle SQL in DuckDB.

    python tests/run_queries.py [sf_dir] [name ...]
"""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, sf_dir):
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"{name}: {len(got)} rows, no oracle, {took:.1f}s", True
    start = time.time()
    result = con.sql(sql)
    want = rows_of(result.columns, result.fetchall())
    oracle = time.time() - start
    ok = sorted(df.columns) == sorted(result.columns) and got == want
    text = f"{name}: {'ok' if ok else 'DIFFERS'} {len(got)} / {len(want)} rows, {took:.1f}s, oracle {oracle:.1f}s"
    if not ok:
        text += f"\n  columns {sorted(df.columns)} / {sorted(result.columns)}\n  types {df.dtypes}"
        text += f"\n  {list(zip(result.columns, result.types))}"
        text += f"\n  only here {[r for r in got if r not in set(want)][:4]}"
        text += f"\n  only oracle {[r for r in want if r not in set(got)][:4]}"
    return text, ok


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def session():
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf)
    bad = 0
    for q in sys.argv[2:] or entry.queries():
        try:
            shown, good = compare(spark, con, q, sf)
        except Exception as error:
            shown, good = f"{q}: FAILED {str(error)[:1500]}", False
        bad += not good
        print(shown, flush=True)
    print("bad:", bad)
