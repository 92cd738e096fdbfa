"""Compare registered queries with DuckDB: ``python -m tests.compare sf0.01 [name or prefix* …]``."""

from __future__ import annotations

import datetime
import sys
import time

import duckdb

from codelattice.plans import load
from codelattice.plans.views import BASE
from codelattice.session import local_session

ROOT = "/root/testdata"


def connect(folder: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return str(value) if isinstance(value, (list, dict)) else value


def compare(spark, con, folder: str, name: str, queries: dict, oracles: dict) -> str:
    """``ok``, ``rows`` where there is no SQL, or what is wrong."""
    df = queries[name](spark, folder)
    got = df.collect()
    if name not in oracles:
        return "rows"
    result = con.execute(oracles[name])
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    want = result.fetchall()
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    a = sorted((tuple(_plain(r[c]) for c in order) for r in got), key=repr)
    b = sorted((tuple(_plain(r[i]) for i in at) for r in want), key=repr)
    if a == b:
        return "ok" if a else "ok, but empty"
    extra, missing = set(a) - set(b), set(b) - set(a)
    return f"{len(a)} and {len(b)} rows in {order}; only Spark {list(extra)[:3]}; only DuckDB {list(missing)[:3]}"


def main() -> int:
    scale, wanted = sys.argv[1], sys.argv[2:]
    folder = f"{ROOT}/{scale}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load()
    con, bad = connect(folder), 0
    for name in queries:
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.perf_counter()
        try:
            said = compare(spark, con, folder, name, queries, oracles)
        except Exception as error:  # report and go on with the rest
            said = f"error {str(error)[:400]}"
        bad += not said.startswith(("ok", "rows"))
        print(f"{name}: {said} ({time.perf_counter() - start:.1f}s)", flush=True)
    print(f"{bad} wrong")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
