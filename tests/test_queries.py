"""Every registered query of the library against its oracle, value by value: what is rounded must be equal."""

import math
import os

import duckdb
import pytest

from decilog.plans import registry
from decilog.session import TABLES

registry.load()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return float(v) if hasattr(v, "as_tuple") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 1e-8 + 1e-12 * abs(a)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, cursor.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(same, a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
