"""Compare registered queries with their SQL equivalents: python tools/check.py [--sf DIR] [name prefixes]."""

from __future__ import annotations

import argparse
import importlib
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cores: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, build, sql, sf_dir):
    t0 = time.time()
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return ("rows-only" if got else "EMPTY"), f"{len(got)} rows", took
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return "FAIL", f"columns {sorted(df.columns)} vs {sorted(cols)}", took
    kinds = {c: t for c, t in df.dtypes}
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return ("ok" if got else "EMPTY"), f"{len(got)} rows", took
    names = sorted(cols)
    sa, sb = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return "FAIL", f"{len(a)} vs {len(b)} rows; only spark {len(sa)}, only sql {len(sb)}\n   cols {names}\n   spark {sa[:2]}\n   sql   {sb[:2]} {kinds if len(kinds) < 4 else ''}", took


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    mod = importlib.import_module("__spark_entry__")
    queries, oracles = mod.queries(), mod.oracle_sql()
    spark, con = session(), connect(args.sf)
    bad = 0
    for name, build in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            verdict, note, took = compare(spark, con, build, oracles.get(name), args.sf)
        except Exception as exc:
            verdict, note, took = "ERROR", str(exc).strip()[:900], 0.0
        bad += verdict in ("FAIL", "ERROR", "EMPTY")
        print(f"{verdict:9s} {name:34s} {took:6.2f}s {note}", flush=True)
    print("bad:", bad)
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
