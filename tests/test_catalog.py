"""Every core query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from pagewright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Run by other tests, against something better than a row count.
SLOW = {"stream_chunks", "stream_pages", "page_events", "content_hash_bulk", "nms_regions"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(v)


def rows(frame, columns):
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query_equals_its_twin(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert name in catalog.ORACLE_SQL, "a query without SQL needs a test of its own"
    want = db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_bulk_hash_equals_the_native_one(spark):
    from pyspark.sql import functions as F

    from pagewright.functions.content import fnv1a, fnv1a_bulk

    df = spark.createDataFrame([(b"memory",), (b"",), (None,), (b"\xff\x00a" * 50,)], "content binary")
    got = df.select(fnv1a(F.col("content")).cast("string"), fnv1a_bulk(F.col("content"))).collect()
    assert got[0][0] == "3348685368019988462" and all(r[0] == r[1] for r in got if r[0] is not None) and got[2][1] is None
