"""Compares a query's rows with those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows_of(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if x is None or x != x else f"{x + 0.0:.6g}" if isinstance(x, float) else str(x) for x in r))
    return sorted(out, key=str)


def check(spark, connection, query, sql, sf_dir):
    a, b = query(spark, sf_dir).toPandas(), connection.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)
