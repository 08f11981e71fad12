"""Run registered queries beside their SQL on one data folder and compare all rows."""

from __future__ import annotations

import collections
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _key(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(_key(r[i]) for i in order) for r in rows)


def compare(spark, con, name, folder):
    """Return (ok, rows, message, seconds)."""
    import __spark_entry__ as entry

    began = time.time()
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    took = time.time() - began
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, len(got), "rows only", took
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    have = rows_of(df.columns, got)
    if sorted(names) != sorted(df.columns):
        return False, len(got), f"columns {df.columns} vs {names}", took
    if want == have:
        return True, len(got), "", took
    extra, missing = list((have - want).items())[:3], list((want - have).items())[:3]
    return False, len(got), f"spark {sum(have.values())} sql {sum(want.values())}; only spark {extra}; only sql {missing}", took


if __name__ == "__main__":
    import re

    from quantspark.session import local_session

    folder = sys.argv[1]
    pattern = sys.argv[2] if len(sys.argv) > 2 else "."
    import __spark_entry__ as entry

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in entry.queries():
        if not re.search(pattern, name):
            continue
        try:
            ok, n, message, took = compare(spark, con, name, folder)
        except Exception as error:  # report and go on to the next query
            ok, n, message, took = False, -1, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} rows={n:7d} {took:6.2f}s {message[:900]}", flush=True)
    print("failures:", bad)
