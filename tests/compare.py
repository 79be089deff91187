"""Runs registered queries beside their SQL and compares the rows: python -m tests.compare SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings vectors vectors_prior "
    "ingestion_registry crawl_state eval_items mix_targets"
).split()


def connect(directory: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(directory, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "tzinfo") and getattr(x, "tzinfo", None) is not None:
        return x.replace(tzinfo=None)
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


def compare(spark, con, name: str, query, sql: str | None, directory: str) -> str:
    t = time.time()
    df = query(spark, directory)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    took = time.time() - t
    if sql is None:
        return f"{name}: {len(mine)} rows, {took:.1f} s, no SQL"
    t = time.time()
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    if sorted(names) != columns:
        return f"{name}: COLUMNS DIFFER {sorted(names)} {columns}"
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    if mine == theirs:
        return f"{name}: {len(mine)} rows equal, {took:.1f} s against {time.time() - t:.1f} s"
    a, b = set(map(repr, mine)), set(map(repr, theirs))
    return f"{name}: DIFFERS, {len(mine)} against {len(theirs)} rows; only here {sorted(a - b)[:4]}; only there {sorted(b - a)[:4]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from quern.session import local_session

    spark, con = local_session(), connect(sys.argv[1])
    sql = e.oracle_sql()
    for name, query in e.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        try:
            print(compare(spark, con, name, query, sql.get(name), sys.argv[1]), flush=True)
        except Exception as error:
            print(f"{name}: FAILED {type(error).__name__} {str(error)[:1500]}", flush=True)
