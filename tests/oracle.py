"""Compare registered queries with their oracle SQL: ``python tests/oracle.py SF_DIR [name …]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def duckdb_connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def compare(spark, con, name, sf_dir):
    """None when both sides agree, else a short description of the difference."""
    from registry import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got == want:
        return None
    extra, missing = list((got - want).elements()), list((want - got).elements())
    return (
        f"{sum(got.values())} rows vs {sum(want.values())}; spark only {len(extra)}, oracle only {len(missing)}\n"
        f"  spark : {[str(x)[:600] for x in sorted(extra, key=str)[:2]]}\n"
        f"  oracle: {[str(x)[:600] for x in sorted(missing, key=str)[:2]]}"
    )


if __name__ == "__main__":
    from conftest import make_session

    from registry import ORACLES, QUERIES

    sf = sys.argv[1]
    session, con = make_session(), duckdb_connection(sf)
    failed = []
    for q in sys.argv[2:] or list(QUERIES):
        start = time.time()
        try:
            problem = compare(session, con, q, sf) if q in ORACLES else None
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {q} {time.time() - start:.1f}s", flush=True)
        if problem:
            print("  " + problem, flush=True)
            failed.append(q)
    print(f"{len(failed)} failed: {failed}")
