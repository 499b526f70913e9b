"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(str, plain.itertuples(index=False, name=None)))


def same(spark_frame, sql, sf_dir=SMALL):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, have = c.execute(sql).df(), spark_frame.toPandas()
    assert sorted(have.columns) == sorted(want.columns)
    columns = sorted(have.columns)
    assert rows(have, columns) == rows(want, columns)
