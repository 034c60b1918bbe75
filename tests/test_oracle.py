"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from oratora import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def cells(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "None"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)[:10] if hasattr(v, "year") else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows(spark, con, sf_dir, name):
    ours, theirs = Q.QUERIES[name](spark, sf_dir).toPandas(), con.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = cells(ours), cells(theirs)
    whole = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    assert a == b, whole


def test_rows_only(spark, sf_dir):
    for name in set(Q.QUERIES) - set(Q.ORACLE_SQL):
        assert Q.QUERIES[name](spark, sf_dir).count() > 0, name
