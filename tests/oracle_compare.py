"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle_compare.py [sf] [name-or-prefix ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if str(type(v).__name__) in ("NaTType", "NAType"):
        return None
    if type(v).__name__ in ("Timestamp", "datetime", "datetime64"):
        return str(v)[:26]
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_norm(x) for x in v)
    return v


def rows(frame):
    cols = sorted(frame.columns)
    data = [tuple(_norm(v) for v in row) for row in frame[cols].itertuples(index=False, name=None)]
    return cols, sorted(data, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    got_cols, got = rows(fn(spark, sf_dir).toPandas())
    if sql is None:
        return len(got) >= 0, f"rows only: {len(got)}"
    want_cols, want = rows(con.execute(sql).df())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        diff = [(c, g, w) for c, g, w in zip(got_cols, *bad[0]) if g != w]
        return False, f"{len(bad)} of {len(got)} rows differ, first: {diff}"
    return True, f"{len(got)} rows"


def main() -> None:
    import __spark_entry__ as entry
    from pulsegrid import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as ex:  # report every query, then fail at the end
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:400]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t:6.2f}s  {msg}", flush=True)
    print("failed:", failed)
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
