"""Comparing a Spark result with a DuckDB result, without regard to order."""

import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: f"{v:.8g}" if isinstance(v, (float, np.floating)) else None if v is None else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(got, want):
    a, b = normal(got), normal(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head().to_string()
