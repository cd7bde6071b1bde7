"""Run registered queries next to their SQL: ``python -m tests.oracle [regex] [sf]``."""

from __future__ import annotations

import datetime as dt
import re
import sys
import threading
import time
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

LIMIT = 60  # seconds per query
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def make_spark(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else (0.0 if v == 0 else v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, list):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, fn, sql, folder):
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(x) for x in df.collect()]
    t1 = time.time()
    if sql is None:
        return {"ok": None, "rows": len(got), "sec": t1 - t0, "cols": df.columns}
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    info = {"rows": len(got), "want": len(want), "sec": t1 - t0, "duck": t2 - t1}
    if sorted(names) != sorted(df.columns):
        return {**info, "ok": False, "why": f"columns {sorted(df.columns)} vs {sorted(names)}"}
    a, b = rows_of(df.columns, got), rows_of(names, want)
    only_a, only_b = a - b, b - a
    if only_a or only_b:
        why = f"{sum(only_a.values())} only spark, {sum(only_b.values())} only sql; cols {sorted(names)}\n"
        key = lambda t: tuple(str(x) for x in t)
        why += "".join(f"    S {x}\n" for x in sorted(only_a, key=key)[:3])
        why += "".join(f"    D {x}\n" for x in sorted(only_b, key=key)[:3])
        return {**info, "ok": False, "why": why}
    return {**info, "ok": True}


def main(pattern=".", sf="0.01"):
    from __spark_entry__ import oracle_sql, queries

    folder = f"/root/testdata/sf{sf}"
    spark, con = make_spark(), duck(folder)
    sqls, bad, total = oracle_sql(), [], 0
    for name, fn in queries().items():
        if not re.search(pattern, name):
            continue
        total += 1
        alarm = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
        alarm.start()
        try:
            res = compare(spark, con, fn, sqls.get(name), folder)
        except Exception as e:  # report and go on with the other queries
            res = {"ok": False, "why": f"{type(e).__name__}: {str(e)[-600:] if 'Python' in type(e).__name__ else str(e)[:600]}"}
        alarm.cancel()
        state = {True: "ok  ", None: "rows", False: "FAIL"}[res["ok"]]
        print(state, name, f"rows={res.get('rows')} {res.get('sec', 0):.2f}s duck={res.get('duck', 0):.2f}s", res.get("why", ""), flush=True)
        if res["ok"] is False:
            bad.append(name)
    print(f"{total - len(bad)}/{total} fine; failed: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
