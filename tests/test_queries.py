"""Every registered query gives the rows of its SQL twin on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def _sorted(rows):
    return sorted((tuple(_cell(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = _sorted(tuple(r[c] for c in cols) for r in df.collect())
    if name not in TWINS:
        assert got is not None
        return
    res = duck.execute(TWINS[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == _sorted(tuple(r[i] for i in at) for r in res.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["domain", "page_id", "canonical_url", "title", "page_type", "quality"]
    assert df.count() > 0


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)
