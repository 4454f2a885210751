"""Every query of the library against its SQL on the smallest tables."""
import math

import duckdb
import pytest

from traceloom import queries as registered

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
_SQL = registered.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, duck, name):
    df = registered.queries()[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    got = [tuple(map(_plain, r)) for r in df.collect()]
    if name not in _SQL:
        assert got
        return
    want = duck.sql(_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order, other = (sorted(range(len(c)), key=c.__getitem__) for c in (df.columns, want.columns))
    assert sorted(repr([r[i] for i in order]) for r in got) == sorted(repr([r[i] for i in other]) for r in want.fetchall())


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert set(registered.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
