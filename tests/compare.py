"""Results of Spark and DuckDB as comparable rows."""

import math
from pathlib import Path

import duckdb


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26]
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(value(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def duck_rows(sf_dir, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    con.execute("SET TimeZone='UTC'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return rows_of(names, got.fetchall())
