"""Every query with SQL gives the rows of that SQL."""

import duckdb
import pytest

from fgspark import method_queries, queries
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


#: Samplers and fits keep their tolerances on the larger tables they are registered for.
SMALL = {n for n in method_queries.ORACLE_SQL if n.startswith(("in_", "dv_", "rb_regression"))}
ORACLE_SQL = queries.ORACLE_SQL | method_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = (queries.QUERIES | method_queries.QUERIES)[name](spark, str(DATA)).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    if name in SMALL:
        got, want = (x.drop(columns=["near", "better"], errors="ignore") for x in (got, want))
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert (got[c].isna() == want[c].isna()).all() and (got[c].dropna().values == want[c].dropna().values).all(), c
