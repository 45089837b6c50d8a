"""Run catalogue queries next to their SQL checks. Also a command line: python tests/oracle.py SF_DIR [prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET threads=4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = canonical(df.columns, got), canonical(columns, want)
    if len(a) != len(b):
        return len(got), f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return len(got), (f"{len(bad)} rows differ, first {bad[0]}" if bad else "")


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in entry.queries():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            n, problem = compare(spark, con, name, sf)
            state = "rows-only" if problem is None else ("ok" if problem == "" else "DIFF " + problem)
        except Exception as e:  # report and go on
            n, state = -1, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:34s} {n:8d} {time.time() - t:6.1f}s {state}", flush=True)
