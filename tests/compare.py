"""Run registered queries and their oracle texts side by side."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

STRICT = bool(os.environ.get("COMPARE_STRICT"))     # compare doubles bit by bit
ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(**conf):
    from pyspark.sql import SparkSession
    builder = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0) if STRICT else f"{v:.6g}"
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(name, spark, con, sf_dir):
    """(ok, message, rows, seconds)"""
    import __spark_entry__ as entry
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, "rows only", len(got), seconds
    cursor = con.execute(sql)
    want_cols = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    a_cols, a = _rows(df.columns, got)
    b_cols, b = _rows(want_cols, want)
    if a_cols != b_cols:
        return False, f"columns {a_cols} != {b_cols}", len(got), seconds
    wrong = {f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema
             if KINDS.get(f.dataType.simpleString(), "?") != types[f.name]}
    if wrong:
        return False, f"types {wrong}", len(got), seconds
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return False, f"rows {len(a)}/{len(b)} {a_cols}\n   spark {only_a}\n   duck  {only_b}", len(got), seconds
    return True, "equal", len(got), seconds


if __name__ == "__main__":
    import __spark_entry__ as entry
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = session(), oracle(sf)
    bad = 0
    for name in entry.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message, rows, seconds = compare(name, spark, con, sf)
        except Exception as e:  # noqa: BLE001
            ok, message, rows, seconds = False, f"{type(e).__name__} {str(e)[:900]}", 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {rows:7d} rows {seconds:6.2f}s {message if not ok or message != 'equal' else ''}", flush=True)
    print("failed:", bad)
