"""Order-insensitive comparison of a query's rows with those of its SQL."""

import os

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def cell(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and not hasattr(v, "__len__") and not hasattr(v, "isoformat"):
        return f"{float(v):.6f}"
    if hasattr(v, "__iter__") and not isinstance(v, str):
        return str([cell(x) for x in v])
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None))


def same(query, sql: str, spark, folder: str, con) -> None:
    a, b = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    ra, rb = rows(a), rows(b)
    assert len(ra) == len(rb)
    assert ra == rb, ([x for x in ra if x not in rb][:3], [x for x in rb if x not in ra][:3])
