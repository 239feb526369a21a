"""Queries that SQL can express give the rows of their SQL."""

import duckdb
import pytest

from fgspark.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and all((got[c].values == want[c].values).all() for c in columns)
