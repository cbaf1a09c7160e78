"""Run queries next to their SQL and compare rows: ``python -m tests.oracle [sf] [name-part ...]``."""

import sys
import time

import duckdb
import pandas as pd

import __spark_entry__ as entry
from plantpulse.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)]
    out = pd.DataFrame({c: df[c].map(lambda v: None if v is None or v != v else v) for c in df.columns}, dtype=object)
    return sorted(map(repr, out.itertuples(index=False, name=None)))


def kinds(df):
    return {c: df[c].dtype.kind for c in sorted(df.columns)}


def compare(spark, con, name, sf):
    got = entry.queries()[name](spark, sf).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, f"rows {len(got)}"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b:
        return True, f"rows {len(a)}" + ("" if kinds(got) == kinds(want) else f" KINDS {kinds(got)} {kinds(want)}")
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return False, f"rows {len(a)}/{len(b)} spark-only {len(only_a)} {only_a[:2]} sql-only {len(only_b)} {only_b[:2]}"


def main(sf, parts):
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in entry.queries():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf)
        except Exception as e:  # report and go on with the other queries
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += ok is False
        print(f"{ {True: 'ok', False: 'FAIL', None: 'rows'}[ok]:5}{name:28}{time.time() - start:6.1f}s {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}", sys.argv[2:])
