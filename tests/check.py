"""Compare registered queries with their DuckDB text: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.9g}")
    if isinstance(value, int):
        return float(f"{float(value):.9g}") if abs(value) < 2**53 else value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(normal(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r),
    )


def compare(spark, con, query, sql, sf_dir):
    """None when equal, otherwise what differs."""
    result = query(spark, sf_dir)
    mine = rows_of(result.columns, [tuple(r) for r in result.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(result.columns) != sorted(names):
        return f"columns {sorted(result.columns)} vs {sorted(names)}", len(mine)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}", len(mine)
    for a, b in zip(mine, theirs):
        if a != b:
            return f"columns {sorted(names)}\n   mine   {a}\n   theirs {b}", len(mine)
    return None, len(mine)


def main():
    from scorebook.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8, "check")
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem, n = compare(spark, con, query, sqls[name], sf_dir)
            else:
                problem, n = None, len(query(spark, sf_dir).collect())
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            problem, n = f"{type(error).__name__}: {str(error)[:900]}", -1
        spark.catalog.clearCache()
        took = time.time() - start
        mark = "ok " if problem is None else "BAD"
        bad += problem is not None
        print(f"{mark} {name} rows={n} {took:.1f}s{'' if name in sqls else ' (rows only)'}"
              + (f"\n    {problem}" if problem else ""), flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
