"""Compare every registered query with its DuckDB statement: ``python check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from skuloom.registry import all_queries
from skuloom.session import build_session
from skuloom.sources.sample_views import TABLES


def cell(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    only = set(sys.argv[2:])
    folder = f"/root/testdata/{sf}"
    import oracle

    statements = oracle.load()
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    bad = 0
    for name, run in all_queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            got = df.collect()
            took = time.time() - start
            if name not in statements:
                print(f"ROWS {name} {len(got)} {took:.1f}s")
                continue
            cur = con.execute(statements[name])
            names = [d[0] for d in cur.description]
            want = cur.fetchall()
            if sorted(names) != sorted(df.columns):
                print(f"BAD  {name}: columns {sorted(set(names) ^ set(df.columns))}")
                bad += 1
                continue
            types = {d[0]: str(d[1]) for d in cur.description}
            a, b = normal(got, df.columns), normal(want, names)
            if a == b:
                print(f"ok   {name} {len(a)} {took:.1f}s")
            else:
                bad += 1
                sa, sb = set(a), set(b)
                print(f"BAD  {name}: spark {len(a)} duck {len(b)} cols {sorted(names)}")
                print("   spark only:", [x for x in a if x not in sb][:3])
                print("   duck only: ", [x for x in b if x not in sa][:3])
            del types
        except Exception as exc:  # report and go on with the next query
            bad += 1
            print(f"ERR  {name}: {str(exc)[:700]}")
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 100))
