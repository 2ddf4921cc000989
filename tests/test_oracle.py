"""Every query with SQL, both sides over the small tables."""

import math

import pytest

from roadlens.plans import registry

from .conftest import DATA


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return round(float(v), 6) + 0.0 if isinstance(v, int | float) or hasattr(v, "as_tuple") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    expected = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(expected.columns, expected.fetchall())
    assert want, "an oracle without rows shows nothing"
    assert got == want


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0
