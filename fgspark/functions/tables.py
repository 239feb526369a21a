"""Index arithmetic of factor tables (first variable fastest) and log-sum-exp, as column expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(*keys: str) -> WindowSpec:
    """All rows of the keys; without a key, all rows, which have to be few."""
    return Window.partitionBy(*keys or (F.lit(0),))


def strides(cards: Column) -> Column:
    """The stride of each position: the product of the cardinalities before it."""
    return F.transform(cards, lambda _, i: F.aggregate(F.slice(cards, F.lit(1), i), F.lit(1).cast("bigint"), lambda a, c: a * c))


def table_size(cards: Column) -> Column:
    return F.aggregate(cards, F.lit(1).cast("bigint"), lambda a, c: a * c)


def index_of(states: Column, steps: Column) -> Column:
    """Linear index of a joint state."""
    return F.aggregate(F.zip_with(states, steps, lambda s, k: s.cast("bigint") * k), F.lit(0).cast("bigint"), lambda a, x: a + x)


def digit(index: Column, step: Column, card: Column) -> Column:
    """The state of the position with this stride in a linear index."""
    return (F.floor(index / step) % card).cast("int")


def with_digit(index: Column, step: Column, card: Column, state: Column) -> Column:
    """The index with one position's state replaced."""
    return index + (state - digit(index, step, card)) * step


def place_of(variables: Column, variable: Column) -> Column:
    """Position of a variable in a scope, null if absent."""
    at = F.array_position(variables, variable)
    return F.when(at > 0, (at - 1).cast("int"))


#: Values are summed in bins of this width (a power of two), relative to the middle of the bin, so no exponential overflows.
BIN = 32


def log_sum_exp(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): log of the sum of exp(value) by keys. Nulls are passed over; only -inf: -inf.

    Sums by key and bin combine before the only shuffle that grows with the rows; a key's few bins are then put together
    relative to its greatest one.
    """
    x = F.col(value).cast("double")
    finite = F.abs(x) < float("inf")
    start = F.when(finite, F.rint(x / BIN)).otherwise(F.lit(0.0))
    share = F.when(finite, F.exp(x - start * BIN)).when(x < 0, F.lit(0.0)).otherwise(x)
    bins = df.where(x.isNotNull()).groupBy(*keys, start.alias("__bin")).agg(F.sum(share).alias("__s"))
    listed = bins.groupBy(*keys).agg(F.max(F.when(F.col("__s") > 0, F.col("__bin"))).alias("__top"), F.collect_list(F.struct("__bin", "__s")).alias("__l"))
    total = F.aggregate("__l", F.lit(0.0), lambda a, b: a + F.when(b["__s"] == 0, F.lit(0.0)).otherwise(b["__s"] * F.exp((b["__bin"] - F.col("__top")) * BIN)))
    return listed.select(*keys, F.when(F.col("__top").isNull(), F.lit(float("-inf"))).otherwise(F.col("__top") * BIN + F.log(total)).alias(out))


def expand_marginal(scope: DataFrame, marginal: DataFrame, states: DataFrame) -> DataFrame:
    """graph_id, factor_id, var_id, ei, p: a variable's marginal (graph_id, var_id, s, p) written to the cells of each of its
    factors that agree with the other variables' states; the other cells are 0 and are left out."""
    at = scope.join(states.select("graph_id", "var_id", "state"), ["graph_id", "var_id"])
    whole = at.groupBy("graph_id", "factor_id").agg(F.sum(F.col("stride") * F.col("state")).alias("ei"))
    cells = at.join(whole, ["graph_id", "factor_id"]).join(marginal, ["graph_id", "var_id"])
    return cells.select("graph_id", "factor_id", "var_id", (F.col("ei") + (F.col("s") - F.col("state")) * F.col("stride")).alias("ei"), "p")


def total_correlation(energy: DataFrame, scope: DataFrame) -> DataFrame:
    """graph_id, factor_id, total_correlation, most: sum of the variables' entropies less the joint one under the factor's
    own distribution exp(-energy) / Z, and that sum less the greatest of them (its bound)."""
    keys = ["graph_id", "factor_id"]
    rows = energy.withColumn("__x", -F.col("energy"))
    p = rows.join(log_sum_exp(rows, keys, "__x", "__z"), keys).select(*keys, "ei", F.exp(F.col("__x") - F.col("__z")).alias("p"))
    h = F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(F.lit(0.0)))
    joint = p.groupBy(*keys).agg(h.alias("joint"))
    one = p.join(scope, keys).groupBy(*keys, "pos", digit(F.col("ei"), F.col("stride"), F.col("card")).alias("s")).agg(F.sum("p").alias("p")).groupBy(*keys, "pos").agg(h.alias("h"))
    return one.groupBy(*keys).agg(F.sum("h").alias("sum"), F.max("h").alias("top")).join(joint, keys).select(*keys, (F.col("sum") - F.col("joint")).alias("total_correlation"), (F.col("sum") - F.col("top")).alias("most"))
