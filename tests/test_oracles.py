"""Every query against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

import basalt.registry as registry
from tests.conftest import SMALL

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return tuple(map(plain, x)) if isinstance(x, list) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    rows = got.collect()
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert rows_of(got.columns, rows) == rows_of(names, want.fetchall())
    else:
        assert rows
