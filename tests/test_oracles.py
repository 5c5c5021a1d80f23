"""Every query of the engine against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pandas as pd
import pytest

from tidepool.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if hasattr(v, "item"):
        return plain(v.item())
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, sf):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLES:
        assert len(got.columns) and len(got)
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
