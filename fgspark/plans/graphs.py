"""Factor graphs over the test tables: counts of column pairs as energies, chains of events, features of embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_BANDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coded(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[int]]:
    """rows with each column's values as 0, 1, ... in sorted order (columns v0, v1, ...), and the cardinalities.

    The columns have few values (a table's axis each), which come to the driver; more than 1000 are refused.
    """
    cards = []
    for i, c in enumerate(columns):
        values = sorted(r[0] for r in rows.select(c).where(F.col(c).isNotNull()).distinct().limit(1001).collect())
        if len(values) > 1000:
            raise ValueError(f"{c} has too many values to be a variable")
        cards.append(len(values))
        rows = rows.withColumn(f"v{i}", (F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) - 1).cast("int"))
    return rows, cards


def count_graph(rows: DataFrame, columns: list[str], scopes: list[tuple[int, ...]]) -> tuple[DataFrame, DataFrame]:
    """(variable, factor with energies) of one graph: a variable per column, a factor per scope with energies -ln(n + 1)."""
    spark = rows.sparkSession
    data, cards = coded(rows, columns)
    counts = data.groupBy(*[f"v{i}" for i in range(len(columns))]).count().collect()  # at most the product of the cardinalities
    variable = spark.createDataFrame([(0, i, c) for i, c in enumerate(cards)], "graph_id bigint, var_id int, card int")
    factors = []
    for k, scope in enumerate(scopes):
        total: dict[int, int] = {}
        for r in counts:
            if all(r[v] is not None for v in scope):
                ei = reduce(lambda a, v: a + r[v[1]] * v[0], zip([_product(cards, scope[:j]) for j in range(len(scope))], scope), 0)
                total[ei] = total.get(ei, 0) + r["count"]
        factors.append((0, k, list(scope), [total.get(e, 0) for e in range(_product(cards, scope))]))
    raw = spark.createDataFrame(factors, "graph_id bigint, factor_id int, vars array<int>, n array<bigint>")
    return variable, raw.select("graph_id", "factor_id", "vars", F.transform("n", lambda n: -F.log(n.cast("double") + 1)).alias("energies"))


def _product(cards: list[int], scope: tuple[int, ...]) -> int:
    return reduce(lambda a, v: a * cards[v], scope, 1)


def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, pos, state, value: each user's events in order of time, the type as a state."""
    events = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null")
    data, _ = coded(events, ["event_type"])
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return data.select("user_id", (F.row_number().over(order) - 1).alias("pos"), F.col("v0").alias("state"), F.coalesce("value", F.lit(0.0)).alias("value"))


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, var_id, state: the labeling of the chains by their own event types."""
    return event_chains(spark, sf_dir).select(F.col("user_id").alias("graph_id"), F.col("pos").alias("var_id"), "state")


def transition_energies(chains: DataFrame, card: int) -> list[float]:
    """-ln of the smoothed share of each step (first state fastest): 25 numbers for 5 states, counted over all chains."""
    nxt = F.lead("state").over(Window.partitionBy("user_id").orderBy("pos"))
    counts = {(r.a, r.b): r.n for r in chains.select(F.col("state").alias("a"), nxt.alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    import math

    rows = {a: sum(counts.get((a, b), 0) + 1 for b in range(card)) for a in range(card)}
    return [-math.log((counts.get((a, b), 0) + 1) / rows[a]) for b in range(card) for a in range(card)]


def event_graphs(spark: SparkSession, sf_dir: str, card: int = EVENT_BANDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variable, factor, factor_type) of the chains: unary factors value * (s + 1) / 100, steps by transition_energies()."""
    chains = event_chains(spark, sf_dir)
    steps = transition_energies(chains, card)
    none = F.lit(None).cast("array<int>")
    variable = chains.select(F.col("user_id").alias("graph_id"), F.col("pos").alias("var_id"), F.lit(card).alias("card"))
    unary = chains.select(F.col("user_id").alias("graph_id"), (2 * F.col("pos")).alias("factor_id"), F.lit("band").alias("type"), F.array("pos").alias("vars"), F.array("value").alias("data"), none.alias("data_idx"))
    pairs = chains.where("pos > 0").select(F.col("user_id").alias("graph_id"), (2 * F.col("pos") - 1).alias("factor_id"), F.lit("step").alias("type"), F.array(F.col("pos") - 1, F.col("pos")).alias("vars"), F.expr("cast(array() as array<double>)").alias("data"), none.alias("data_idx"))
    types = spark.createDataFrame(
        [("band", "linear", [card], card, 1, [(s + 1) / 100 for s in range(card)], None, None, None), ("step", "table", [card, card], card * card, 0, steps, None, None, None)],
        "name string, kind string, card array<int>, prod_card bigint, data_size int, w array<double>, tie array<int>, rbf_n int, log_beta double",
    )
    return variable, unary.unionByName(pairs), types


def embedding_graphs(spark: SparkSession, sf_dir: str, kind: str = "linear", card: int = 10, size: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variable, factor, factor_type): a graph per vector with one variable, its label, and one factor of the given kind.

    Weights are fixed by a rule: entry e, feature d has ((7 d + 13 e) mod 11 - 5) / 10.
    """
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    variable = rows.select(F.col("vec_id").alias("graph_id"), F.lit(0).alias("var_id"), F.lit(card).alias("card"))
    factor = rows.select(F.col("vec_id").alias("graph_id"), F.lit(0).alias("factor_id"), F.lit(kind).alias("type"), F.array(F.lit(0)).alias("vars"), F.transform("embedding", lambda x: x.cast("double")).alias("data"), F.lit(None).cast("array<int>").alias("data_idx"))
    rule = lambda e, d: ((7 * d + 13 * e) % 11 - 5) / 10
    w = [rule(e, d) for e in range(card) for d in range(size)]
    tie, n = None, None
    if kind == "tied":
        w, tie = w[: 3 * size], [e % 4 - 1 for e in range(card)]
    if kind == "rbf":
        n = 2
        w = [x for e in range(card) for x in [1.0 + i for i in range(n)] + [rule(e, d + i) / 5 for i in range(n) for d in range(size)]]
    types = spark.createDataFrame([(kind, kind, [card], card, size, w, tie, n, 0.0)], "name string, kind string, card array<int>, prod_card bigint, data_size int, w array<double>, tie array<int>, rbf_n int, log_beta double")
    return variable, factor, types
