"""Compare queries with their oracle SQL in DuckDB."""

import glob
import math
import os

import duckdb


def canonical(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def mismatch(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(canonical(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    got = sorted((tuple(canonical(r[n]) for n in sorted(names)) for r in df.collect()), key=repr)
    return len(got), len(want), [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
