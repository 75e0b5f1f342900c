"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

ROOT = Path("/root/testdata")


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def compare(spark, name: str, query, sql: str, sf: str = "sf0.001") -> str:
    """Empty if the results agree, else what differs."""
    d = ROOT / sf
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in d.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    want, wcols = rows_of([c[0] for c in cur.description], cur.fetchall())
    df = query(spark, str(d))
    got, gcols = rows_of(df.columns, df.collect())
    if wcols != gcols:
        return f"{name}: columns {gcols} and {wcols}"
    if got != want:
        a, b = [x for x in got if x not in want][:3], [x for x in want if x not in got][:3]
        return f"{name}: {len(got)} and {len(want)} rows; only here {a}; only there {b}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as e
    from vocata.session import get_spark

    spark, sf, names = get_spark(), sys.argv[1], sys.argv[2:]
    sql, bad = e.oracle_sql(), 0
    import time

    for k, f in e.queries().items():
        if names and not any(k.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            said = compare(spark, k, f, sql[k], sf) if k in sql else f"-- {f(spark, str(ROOT / sf)).count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(k, said or "OK", f"{time.time() - t:.1f}s", flush=True)
