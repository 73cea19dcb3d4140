"""Run the registered queries and their SQL side by side.

    python tests/compare.py [folder] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else the first difference."""
    left_rows = spark_df.collect()
    left_cols = spark_df.columns
    cur = con.execute(sql)
    right_cols = [c[0] for c in cur.description]
    right_rows = cur.fetchall()
    if sorted(left_cols) != sorted(right_cols):
        return f"columns {sorted(left_cols)} != {sorted(right_cols)}"
    left, right = rows_of(left_cols, left_rows), rows_of(right_cols, right_rows)
    if left == right:
        return None if left else "both empty"
    ls, rs = set(left), set(right)
    only_l, only_r = sorted(ls - rs), sorted(rs - ls)
    return (
        f"rows {len(left)} vs {len(right)}; only ours {len(only_l)}: {str(only_l[:2])[:900]}; "
        f"only sql {len(only_r)}: {str(only_r[:2])[:900]}"
    )


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tests.conftest import session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    prefixes = tuple(args[1:])
    spark, con = session(), duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                df = fn(spark, folder)
                n = "sql"
                diff = difference(df, con, oracles[name])
            else:
                n, diff = fn(spark, folder).count(), None
        except Exception as e:  # report and go on
            n, diff = "?", f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {name} [{n}] {time.time() - t0:.1f}s {diff or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
