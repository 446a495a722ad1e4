"""Compares a query with its SQL run by DuckDB on the same tables.

Also a command: python tests/oracle.py [sf] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    columns = sorted(df.columns)
    got = [tuple(_plain(row[c]) for c in columns) for row in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {sorted(set(names) ^ set(columns))}"
    order = [names.index(c) for c in columns]
    want = [tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    if not got:
        return "no rows"
    types = [{type(v) for v in col if v is not None} for col in zip(*got)]
    sql_types = [{type(v) for v in col if v is not None} for col in zip(*want)]
    wrong = [c for c, a, b in zip(columns, types, sql_types) if a != b]
    if wrong:
        return f"types differ in {wrong}"
    extra, lacking = Counter(got) - Counter(want), Counter(want) - Counter(got)
    if extra or lacking:
        a, b = sorted(extra, key=str)[0], sorted(lacking, key=str)[0]
        cells = [(c, x, y) for c, x, y in zip(columns, a, b) if x != y]
        return f"{sum(extra.values())} rows differ, such as {cells[:6]}"
    return None


def main(argv: list[str]) -> int:
    from paneloom.catalog import CATALOG
    from paneloom.session import local_session

    sf_dir = f"{DATA}/sf{argv[0] if argv else '0.01'}"
    names = argv[1:] or list(CATALOG)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = CATALOG[name].run(spark, sf_dir)
            if CATALOG[name].sql is None:
                verdict = f"{len(df.collect())} rows, no SQL"
            else:
                verdict = compare(df, con, CATALOG[name].sql) or "equal"
        except Exception as error:  # a report of all queries
            verdict = f"ERROR {type(error).__name__} {str(error)[:600]}"
        bad += verdict != "equal" and not verdict.endswith("no SQL")
        print(f"{name:28s} {time.time() - start:6.1f}s {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
