"""Compares a query with its SQL on the same tables."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value) or str(value) in ("NaT", "<NA>"):
        return "null"
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, float):
        return f"{value:.9g}" if value else "0"
    return f"{value}.0"[:-2] if isinstance(value, int) and not isinstance(value, bool) else str(value)


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False))


def check(spark, con, query, sql, sf_dir):
    got, want = rows(query(spark, sf_dir).toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
