"""Run registered queries beside their SQL on one folder of tables and compare."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=key)


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    same = got == want
    print(f"{'ok  ' if same else 'DIFF'} {name:24s} rows {len(got[1])}/{len(want[1])} "
          f"spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s", flush=True)
    if not same:
        print("   columns", got[0], want[0])
        shown = 0
        for a, b in zip(got[1], want[1]):
            if a != b and shown < 2:
                print("   spark", repr(a)[:700])
                print("   sql  ", repr(b)[:700])
                shown += 1
    return same


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = e.oracle_sql()
    bad = 0
    for name, query in e.queries().items():
        if name not in sql or (names and name not in names):
            continue
        try:
            bad += not compare(spark, con, name, query, sql[name], sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"FAIL {name}: {str(error)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
