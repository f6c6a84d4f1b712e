"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from stratum.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (bool, str)):
        return str(v)
    try:
        return repr(float(v))
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship_and_names():
    import __spark_entry__ as entry

    assert catalog.FLAGSHIP in catalog.QUERIES
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(entry.queries())
