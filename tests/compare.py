"""Spark results beside DuckDB's, as the driver compares them."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(None if not isinstance(v, list | tuple) and pd.isna(v) else (round(float(v), 6) + 0.0 if isinstance(v, float) else str(v) if not isinstance(v, int | bool) else v) for v in (x.item() if hasattr(x, "item") else x for x in r)))
    return sorted(out, key=repr)


def difference(spark, con, f, sql, sf_dir):
    got, want = f(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b, strict=True):
        if any(p != q and not (isinstance(p, float | int) and isinstance(q, float | int) and abs(p - q) <= 1e-9 * max(1, abs(q))) for p, q in zip(x, y, strict=True)):
            return f"{x} against {y}"
    return ""
