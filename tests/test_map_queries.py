"""The labelings of approximate methods on small tables where the method alone ends elsewhere, against SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from fgspark import method_queries
from fgspark.kernels import approximate
from fgspark.kernels.exact import enumerate_map
from fgspark.kernels.graph import Graph


@pytest.fixture(scope="module", params=[3, 41, 64, 286])
def small(request, tmp_path_factory):
    """40 orders with equal or loosely bounded labelings."""
    rng, n, folder = np.random.default_rng(request.param), 40, tmp_path_factory.mktemp("orders")
    status, priority, segment = rng.integers(0, 3, n), rng.integers(0, 5, n), rng.integers(0, 5, n)
    pd.DataFrame({"o_orderkey": range(n), "o_custkey": range(n), "o_orderstatus": [f"s{i}" for i in status], "o_orderpriority": [f"p{i}" for i in priority]}).to_parquet(folder / "orders.parquet")
    pd.DataFrame({"c_custkey": range(n), "c_mktsegment": [f"m{i}" for i in segment]}).to_parquet(folder / "customer.parquet")
    return folder


def _same(spark, folder, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    assert sorted(map(tuple, method_queries.QUERIES[name](spark, str(folder)).collect())) == sorted(con.execute(method_queries.ORACLE_SQL[name]).fetchall())


def test_annealing(spark, small):
    _same(spark, small, "in_map_annealing_orders")


def test_proven_from_anywhere():
    rng = np.random.default_rng(5)
    for _ in range(20):
        graph = Graph([3, 2, 4, 3], [(s, rng.integers(-2, 3, [[3, 2, 4, 3][v] for v in s]).astype(float)) for s in ((0, 1), (1, 2, 3), (0, 3), (2,), (0, 2))])
        assert approximate.proven_map(graph, [int(rng.integers(0, c)) for c in graph.cards]) == enumerate_map(graph)


def test_diffusion(spark, small):
    _same(spark, small, "in_map_diffusion_orders")


def test_dual_decomposition(spark, small):
    _same(spark, small, "in_map_lp_orders")


def test_min_sum(spark, small):
    _same(spark, small, "in_map_bp_orders")
