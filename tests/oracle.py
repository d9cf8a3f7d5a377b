"""Comparison of a Spark result with DuckDB SQL over the same Parquet files."""

import glob
import os

import duckdb


def duck(sf_dir: str, sql: str):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        where = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{where}'")
    return c.execute(sql).df()


def rows(frame):
    columns = sorted(frame.columns)
    text = frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).replace({r"^(-?\d+)\.0$": r"\1"}, regex=True)
    return columns, sorted(map(tuple, text.values.tolist()))


def same(df, sf_dir: str, sql: str) -> int:
    got, want = rows(df.toPandas()), rows(duck(sf_dir, sql))
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    different = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not different, different[:3]
    return len(got[1])
