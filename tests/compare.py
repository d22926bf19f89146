"""Run a registered query on Spark and its SQL on DuckDB and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """Strict on types: an SQL DECIMAL is not a double, an integer is not a boolean."""
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (bool, Decimal)):
        return f"{type(value).__name__} {value}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    spark_rows = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    sql_rows = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} vs {len(sql_rows)}"
    bad = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    return f"{len(bad)} of {len(sql_rows)} rows differ, first {bad[:2]}" if bad else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from panelworks.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    checks = oracle_sql()
    failed = 0
    for name, build in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in checks:
                problem = difference(df, con, checks[name])
            else:
                problem = None if df.collect() else "no rows"
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += problem is not None
        status = "ok" if problem is None else f"FAIL {problem}"
        print(f"{name:32s} {time.time() - start:6.1f}s {'' if name in checks else '(rows only) '}{status}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
