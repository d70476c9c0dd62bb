"""Run catalog queries in Spark and their SQL twins in DuckDB and compare.

    python tests/oracle_check.py [sf_dir] [name-substring ...]

Prints one line per query: rows, schema and exact-hash agreement.
"""
from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer() and abs(v) < 2**53:
            return int(v)
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def frame_hash(pdf: pd.DataFrame) -> tuple[int, str]:
    cols = sorted(pdf.columns)
    rows = sorted(repr(tuple(_norm(x) for x in r)) for r in pdf[cols].itertuples(index=False, name=None))
    return len(rows), hashlib.sha1("\n".join(rows).encode()).hexdigest()


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    ts = time.time() - t
    if sql is None:
        return f"{name:45s} rows={len(spdf):6d} (no oracle) {ts:.2f}s"
    ddf = con.execute(sql).df()
    ok_cols = sorted(spdf.columns) == sorted(ddf.columns)
    if not ok_cols:
        return f"{name:45s} COLUMNS spark={sorted(spdf.columns)} duck={sorted(ddf.columns)}"
    hs, hd = frame_hash(spdf), frame_hash(ddf[list(spdf.columns)])
    status = "OK " if hs == hd else "DIFF"
    msg = f"{name:45s} {status} rows={len(spdf)}/{len(ddf)} {ts:.2f}s"
    if hs != hd and len(spdf) == len(ddf):
        cols = sorted(spdf.columns)
        a = spdf[cols].sort_values(cols, ignore_index=True) if len(spdf) else spdf
        b = ddf[cols].sort_values(cols, ignore_index=True) if len(ddf) else ddf
        for c in cols:
            diff = [(x, y) for x, y in zip(a[c], b[c]) if _norm(x) != _norm(y)]
            if diff:
                msg += f"\n     {c}: {diff[:3]} ({len(diff)} diffs)"
    return msg


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    from tabulon.session import get_spark
    import __spark_entry__ as E
    spark = get_spark()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            line = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            line = f"{name:45s} ERROR {type(e).__name__}: {str(e)[:300]}"
        if "OK " not in line and "no oracle" not in line:
            bad += 1
        print(line, flush=True)
    print(f"-- {bad} not matching")


if __name__ == "__main__":
    main()
