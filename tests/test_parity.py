"""Every engine query against its SQL oracle on DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

from skein.plans import probes
from skein.sources.files import TABLES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(probes.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = probes.QUERIES[name](spark, sf_dir)
    got = [tuple(plain(v) for v in r) for r in df.collect()]
    if name not in probes.SQL:
        assert got
        return
    want = oracle.sql(probes.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = [df.columns.index(c) for c in columns]
    assert sorted((tuple(r[i] for i in order) for r in got), key=repr) == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(probes.SQL) <= set(probes.QUERIES)
