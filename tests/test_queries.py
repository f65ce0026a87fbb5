"""Every registered query with a SQL check gives the same rows in both engines."""

import collections
import math

import pytest

import __spark_entry__ as entry

CHECKS = entry.oracle_sql()
QUERIES = entry.queries()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    cursor = duck.execute(CHECKS[name])
    names = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = collections.Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = collections.Counter(
        tuple(plain(r[names.index(c)]) for c in order) for r in expected
    )
    assert got == want


def test_entry_is_not_empty(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
