"""Builders: models of named factor types, graphs whose factors name types and data sources, and models saved and loaded."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "name string, kind string, card array<int>, prod_card bigint, data_size int, w array<double>, tie array<int>, rbf_n int, log_beta double"


def _type(name: str, kind: str, card: list[int], size: int, w: list[float], tie: list[int] | None = None, n: int | None = None, log_beta: float | None = None) -> tuple:
    if not name or not card or min(card) < 1:
        raise ValueError("a type has a name and at least one variable, of at least one state")
    return name, kind, list(card), math.prod(card), size, [float(x) for x in w], tie, n, log_beta


def table(name: str, card: list[int], w: list[float] = ()) -> tuple:
    """A type whose weights are the energies, the first variable fastest; without weights its factors bring their own."""
    if len(w) not in (0, math.prod(card)):
        raise ValueError(f"{name}: {math.prod(card)} weights are needed")
    return _type(name, "table", card, 0, w)


def linear(name: str, card: list[int], w: list[list[float]]) -> tuple:
    """w: a row for each entry of the table, a weight for each of the data."""
    if len(w) != math.prod(card) or len({len(r) for r in w}) != 1:
        raise ValueError(f"{name}: {math.prod(card)} equally long rows of weights are needed")
    return _type(name, "linear", card, len(w[0]), [x for row in w for x in row])


def tied(name: str, card: list[int], tie: list[int], w: list[float], size: int = 0) -> tuple:
    """Entries with the same tie share weights; -1 has energy 0."""
    if len(tie) != math.prod(card) or len(w) != (max(tie) + 1) * max(size, 1):
        raise ValueError(f"{name}: a tie for each entry and weights for each tie are needed")
    return _type(name, "tied", card, size, w, list(tie))


def rbf_net(name: str, card: list[int], alpha: list[list[float]], centers: list[list[list[float]]], log_beta: float) -> tuple:
    """alpha: amplitudes, centers: positions of each entry's basis functions."""
    n, size = len(alpha[0]), len(centers[0][0])
    if len(alpha) != math.prod(card) or any(len(a) != n or len(c) != n or any(len(x) != size for x in c) for a, c in zip(alpha, centers)):
        raise ValueError(f"{name}: equally many amplitudes and centers for each entry are needed")
    return _type(name, "rbf", card, size, [x for a, c in zip(alpha, centers) for x in [*a, *(y for p in c for y in p)]], None, n, log_beta)


def model(spark: SparkSession, types: list[tuple]) -> DataFrame:
    """The table of factor types, one row each; names must differ."""
    names = [t[0] for t in types]
    if len(set(names)) != len(names):
        raise ValueError("two types have one name")
    return spark.createDataFrame(types, MODEL)


def save_model(types: DataFrame, path: str) -> None:
    types.coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def with_sources(factor: DataFrame, sources: DataFrame) -> DataFrame:
    """The factors with the data of the source they name (dsrc_id); without one, their own data.

    factor: graph_id, factor_id, type, vars and any of data, data_idx, dsrc_id. sources: graph_id, dsrc_id, data and maybe
    data_idx, each stored once however many factors share it. A factor with data and a source raises an error when it is
    read, as does one whose source is not there.
    """
    kinds = {"data": "array<double>", "data_idx": "array<int>", "dsrc_id": "int"}
    rows = factor.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in factor.columns})
    own = sources.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in sources.columns})
    both = rows.join(own.select("graph_id", "dsrc_id", F.col("data").alias("__d"), F.col("data_idx").alias("__i"), F.lit(True).alias("__there")), ["graph_id", "dsrc_id"], "left")
    twice, lost = F.col("dsrc_id").isNotNull() & (F.size("data") > 0), F.col("dsrc_id").isNotNull() & F.col("__there").isNull()
    data = F.when(F.coalesce(twice, F.lit(False)), F.raise_error(F.lit("a factor has data and a data source")).cast("array<double>")).when(lost, F.raise_error(F.lit("no such data source")).cast("array<double>"))
    there = F.col("__there").isNotNull()
    return both.select("graph_id", "factor_id", "type", "vars", data.when(there, F.col("__d")).otherwise(F.col("data")).alias("data"), F.when(there, F.col("__i")).otherwise(F.col("data_idx")).alias("data_idx"))


def by_number(factor: DataFrame, types: DataFrame, names: list[str]) -> DataFrame:
    """Factors whose `type` is a number from 1 get the name at that place of names; the names must be types of the model."""
    known = {r.name for r in types.select("name").collect()}  # a row per type
    if not set(names) <= known:
        raise ValueError("a name is no type of the model")
    return factor.withColumn("type", F.get(F.array(*map(F.lit, names)), F.col("type").cast("int") - 1))
