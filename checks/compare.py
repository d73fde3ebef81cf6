"""Run registered queries next to their SQL and report what differs.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return f"{value:.6g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    return str(value)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> None:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from ledgerloom.session import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = session("checks", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), []
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            got = df.collect()
        except Exception as error:  # report and go on with the next query
            print(f"FAIL  {name}: {str(error)[:600]}", flush=True)
            bad.append(name)
            continue
        took = time.time() - start
        if name not in ORACLE:
            print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        try:
            start = time.time()
            cur = con.execute(ORACLE[name])
            columns = [d[0] for d in cur.description]
            want = rows_of(columns, cur.fetchall())
            duck_took = time.time() - start
        except Exception as error:
            print(f"SQL   {name}: {str(error)[:700]}", flush=True)
            bad.append(name)
            continue
        mine = rows_of(df.columns, got)
        if sorted(columns) != sorted(df.columns):
            print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(columns)}", flush=True)
            bad.append(name)
        elif mine != want:
            extra, missing = list((mine - want).items())[:3], list((want - mine).items())[:3]
            print(f"DIFF  {name}: {len(got)} vs {sum(want.values())}; spark only {extra}; sql only {missing}", flush=True)
            bad.append(name)
        else:
            print(f"ok    {name}: {len(got)} rows, {took:.1f}s (sql {duck_took:.1f}s)", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} fine; not fine: {bad}", flush=True)


if __name__ == "__main__":
    main()
