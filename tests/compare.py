"""Runs registered queries and their SQL on the same tables and compares the rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("" if v is None or (isinstance(v, float) and v != v) or v is pd.NaT else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


def differ(spark, con, sf_dir: str, make, sql: str) -> str:
    """Empty where both give the same columns and rows."""
    ours, theirs = make(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    for c in ours.columns:
        if pd.api.types.is_integer_dtype(ours[c]) and pd.api.types.is_float_dtype(theirs[c]):
            ours[c] = ours[c].astype(float)
        elif pd.api.types.is_float_dtype(ours[c]) and pd.api.types.is_integer_dtype(theirs[c]):
            theirs[c] = theirs[c].astype(float)
    a, b = rows(ours), rows(theirs)
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; only in one: {only}"
    return ""
