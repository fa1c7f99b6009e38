"""Comparison of a query with its oracle in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(df):
    columns = sorted(df.columns)
    cell = lambda x: None if x is None or x != x else (float(x) if isinstance(x, float) else x)
    return columns, sorted(repr(tuple(map(cell, row))) for row in df[columns].astype(object).itertuples(index=False))


def assert_same(query, sql, spark, sf_dir):
    got, want = plain(query(spark, sf_dir).toPandas()), plain(connect(sf_dir).execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
