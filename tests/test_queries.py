"""Every query against its SQL, and each one lazily plannable."""

import math

import duckdb
import pytest

from loomtide.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([None if isinstance(v[i], float) and math.isnan(v[i]) else v[i] for i in order] for v in values), key=lambda r: [(x is None, str(type(x)), x) if not isinstance(x, (int, float)) else (False, "n", round(x, 4)) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(SQL[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            if isinstance(x, float) and y is not None:
                assert x == pytest.approx(float(y), abs=2e-6, rel=1e-6)
            else:
                assert x == y


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_others_give_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).limit(5).count() > 0
