"""Compare registered queries with their SQL on DuckDB.

Run ``python tests/oracle.py [sf_dir] [name ...]`` for a table of results.
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, Decimal):
        return format(value.normalize(), "f") if value else "0"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def table_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = sorted(tuple(plain(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], data


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    df = fn(spark, sf_dir)
    got = table_of(df.columns, df.collect())
    cursor = con.execute(sql)
    want = table_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} <> {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = sorted(set(got[1]) - set(want[1]))[:3], sorted(set(want[1]) - set(got[1]))[:3]
        return f"{len(got[1])} rows <> {len(want[1])}; only here {extra[0]}, only there {extra[1]}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(bad)} of {len(got[1])} rows differ; columns {got[0]}, first {bad[:2]}" if bad else None


def main() -> None:
    import __spark_entry__ as entry

    from pricetrail.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = local_session(8), connect(sf_dir)
    failures = 0
    for name in args or sorted(queries):
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, queries[name], oracles[name], sf_dir) or "ok"
            else:
                result = f"rows only: {len(queries[name](spark, sf_dir).collect())}"
        except Exception as exc:  # report and go on with the next query
            result = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        failures += not (result == "ok" or result.startswith("rows only"))
        print(f"{name:28s} {time.time() - start:6.2f}s {result}", flush=True)
    print("failures:", failures)
    spark.stop()


if __name__ == "__main__":
    main()
