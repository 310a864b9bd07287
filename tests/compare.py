"""Run named queries next to their SQL twin and report differences: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _shown(v: object) -> object:
    return tuple(_shown(x) for x in v) if isinstance(v, list) else v


def rows_of(columns: list[str], rows: list) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_shown(r[i]) for i in order) for r in rows)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides hold the same rows."""
    mine_cols, mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    cols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine_cols != cols:
        return f"columns {mine_cols} != {cols}"
    if mine == theirs:
        return None
    only_mine, only_theirs = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
    return f"rows {sum(mine.values())} / {sum(theirs.values())}; only here {only_mine}; only there {only_theirs}"


def main() -> None:
    from belegwerk.plans import catalog
    from belegwerk.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    chosen = sys.argv[2:] or catalog.names()
    folder = f"/root/testdata/{sf}"
    spark, con = local_session(cores=os.environ.get("CORES", "*")), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in chosen:
        t0 = time.time()
        try:
            df = catalog.run(name, spark, folder)
            if name in catalog.sql():
                problem = difference(df, con, catalog.sql()[name])
            else:
                problem, n = None, df.count()
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - t0:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
