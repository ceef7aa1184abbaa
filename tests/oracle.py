"""Run a query and its SQL side by side."""

from __future__ import annotations

import numbers

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def same(spark, query, sql: str, folder: str = SMALL) -> pd.DataFrame:
    got = query(spark, folder).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def value(x: object) -> str:
        if pd.isna(x):
            return "null"
        return str(float(x)) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    rows = lambda df: sorted(tuple(map(value, r)) for r in df[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
    return got
