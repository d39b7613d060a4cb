"""Every query with SQL gives the SQL's rows, columns and types."""

from collections import Counter

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() == 110


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, D)
    got = df.collect()
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall())
    assert Counter(tuple(r[c] for c in sorted(names)) for r in got) == want
