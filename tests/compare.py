"""Side-by-side comparison of a query's rows with its SQL's."""

from __future__ import annotations

import math
from pathlib import Path


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, [tuple(normal(r[c]) for c in cols) for r in df.collect()]


def sql_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    cols = sorted(names)
    return cols, [tuple(normal(row[names.index(c)]) for c in cols) for row in r.fetchall()]


def ordered(rows):
    return sorted(rows, key=lambda x: tuple((v is None, str(v)) for v in x))
