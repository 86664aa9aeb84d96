"""Comparing a query's rows with DuckDB's."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    return sorted(str([plain(r[i]) for i in sorted(range(len(columns)), key=columns.__getitem__)]) for r in rows)


def assert_same(df, sql: str, sf_dir: str) -> None:
    c = connect(sf_dir)
    found = c.execute(sql)
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())
