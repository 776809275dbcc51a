"""Spark rows against the rows of a query's SQL in DuckDB."""

import math
import os

import duckdb

SF = os.environ.get("QF_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def same(spark, query, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = query(spark, SF)
    names = sorted(got.columns)
    cursor = c.execute(sql)
    told = [d[0] for d in cursor.description]
    assert sorted(told) == names
    at = [told.index(n) for n in names]
    key = lambda r: tuple(map(repr, r))
    want = sorted((tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()), key=key)
    rows = sorted((tuple(_plain(r[n]) for n in names) for r in got.collect()), key=key)
    assert len(rows) == len(want) and rows == want
