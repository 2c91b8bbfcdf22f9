"""Run registered queries next to their SQL in DuckDB: python tests/oracle_check.py [--sf DIR] [name ...]"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if type(value).__name__ == "Decimal":
        value = float(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19].replace("T00:00:00", "")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(row[i]) for i in order) for row in rows), key=lambda t: tuple((v is None, str(type(v)), v) for v in t))


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (a == b or abs(a - b) <= 1.5e-6 * max(1.0, abs(a), abs(b)))
    return a == b


def compare(spark, con, name, fn, sql, sf):
    """(ok, exact, message)"""
    df = fn(spark, sf)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    if sql is None:
        return True, None, f"{len(got)} rows, no SQL"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(got_columns):
        return False, False, f"columns {sorted(got_columns)} != {sorted(columns)}"
    a, b = rows_of(got_columns, got), rows_of(columns, want)
    if len(a) != len(b):
        return False, False, f"{len(a)} rows != {len(b)}"
    exact = a == b
    if not exact:
        bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        if not all(all(same(u, v) for u, v in zip(x, y, strict=True)) for x, y in bad):
            return False, False, f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}"
        return True, False, f"{len(a)} rows, {len(bad)} differ in the last digit, e.g. {bad[0]}"
    return True, True, f"{len(a)} rows"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--conf", action="append", default=[], help="key=value for the session")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from crosslane.session import build_session

    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
        **dict(c.split("=", 1) for c in args.conf),
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duck(args.sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    failed = 0
    for name in names:
        t = time.time()
        try:
            ok, exact, message = compare(spark, con, name, queries[name], oracle.get(name), args.sf)
        except Exception as e:
            ok, exact, message = False, False, "".join(traceback.format_exception_only(e))[:700]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += not ok
        mark = "ok  " if exact or (ok and exact is None) else "near" if ok else "FAIL"
        print(f"{mark} {name} {time.time() - t:.1f}s {message}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
