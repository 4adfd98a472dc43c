"""Compares a query with its SQL in DuckDB, order aside."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _text(x) -> str:
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return str([_text(y) for y in x])
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_text(x) for x in r) for r in df.itertuples(index=False))


def same(spark_df, con, sql: str) -> None:
    got, want = spark_df.toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
