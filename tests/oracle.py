"""Runs registered queries next to their SQL in DuckDB and compares the results."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int):
        return f"{v}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


SAME = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "int": "INTEGER"}


def compare(con, spark, sf_dir, entry):
    """None when equal, else a description of the difference."""
    df = entry.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if entry.sql is None:
        return None if got else "no rows"
    cur = con.execute(entry.sql)
    want_names = [c[0] for c in cur.description]
    want_types = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    types = [(n, t, want_types[n]) for n, t in df.dtypes if SAME.get(t) != want_types[n]]
    if types:
        return f"types {types}"
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:2]
        missing = [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; spark only {extra}; sql only {missing}"
    return None if a else "equal but empty"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from spanloom.plans.catalog import ENTRIES
    from spanloom.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    wanted = sys.argv[1:]
    bad = 0
    for name, entry in ENTRIES.items():
        if wanted and name not in wanted:
            continue
        t0 = time.time()
        try:
            problem = compare(con, spark, sf, entry)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}".replace("\n", " ")
        took = time.time() - t0
        if problem or took > 8:
            bad += bool(problem)
            print(f"[{took:5.1f}s] {name}: {problem}", flush=True)
    print("checked, problems:", bad)
