"""The driver contract, and every registered query against its DuckDB oracle
on sf0.001 (the driver does the same at sf0.01)."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as E

from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "rank" in df.columns


def test_every_query_has_an_oracle():
    assert set(E._own_queries()) == set(E._own_oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, list):
        return repr([_norm(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E._own_queries()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    s = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == cols
    o = sorted(tuple(_norm(r[ocols.index(c)]) for c in cols) for r in cur.fetchall())
    assert s == o
