"""Energies of factors, of labelings and of beliefs, and the gradients that flow back to the types' weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import strides


def scopes(factor: DataFrame, variable: DataFrame) -> DataFrame:
    """A row per factor and position: graph_id, factor_id, pos, var_id, card, stride."""
    at = factor.select("graph_id", "factor_id", F.posexplode("vars").alias("pos", "var_id"))
    listed = at.join(variable, ["graph_id", "var_id"]).groupBy("graph_id", "factor_id").agg(F.sort_array(F.collect_list(F.struct("pos", "var_id", "card"))).alias("s"))
    steps = strides(F.col("s.card"))
    return listed.select("graph_id", "factor_id", F.posexplode(F.arrays_zip("s", steps.alias("k"))).alias("pos", "x")).select("graph_id", "factor_id", "pos", "x.s.var_id", "x.s.card", F.col("x.k").alias("stride"))


def _dot(data: Column, w: Column, ei: Column, size: Column) -> Column:
    return F.aggregate(F.zip_with(data, F.slice(w, ei * size + 1, size), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def _sparse_dot(data: Column, at: Column, w: Column, ei: Column, size: Column) -> Column:
    return F.aggregate(F.zip_with(data, at, lambda x, i: x * F.get(w, (ei * size + i).cast("int"))), F.lit(0.0), lambda a, x: a + x)


def energy_tables(factor: DataFrame, factor_type: DataFrame) -> DataFrame:
    """The factors with `energies`, an array of their tables (first variable fastest), and `cards`, their variables' states.

    By the type's kind: "table" takes the weights, or the factor's data if the type has none; "linear" multiplies data
    (dense, or sparse with data_idx) with each entry's weights; "tied" does so with shared weights (tie -1: energy 0);
    "rbf" sums alpha exp(-exp(beta) |data - center|^2) over each entry's basis functions. The types are few and
    broadcast by Spark if their size allows; no factor's row is exploded.
    """
    t = factor_type.select(F.col("name").alias("type"), "kind", F.col("card").alias("cards"), "prod_card", "data_size", "w", "tie", "rbf_n", "log_beta")
    rows = factor.drop("cards").join(t, "type")
    entries = F.sequence(F.lit(0).cast("bigint"), F.col("prod_card") - 1)
    size, w, data, at = (F.col(c) for c in ("data_size", "w", "data", "data_idx"))
    sparse = F.coalesce(F.size("data_idx") > 0, F.lit(False))
    linear = F.transform(entries, lambda e: F.when(sparse, _sparse_dot(data, at, w, e, size)).otherwise(_dot(data, w, e, size)))
    table = F.when(F.coalesce(F.size("w"), F.lit(0)) > 0, w).when(sparse, F.transform(entries, lambda e: F.coalesce(F.try_element_at(F.map_from_arrays(at, data), e.cast("int")), F.lit(0.0)))).otherwise(data)
    bare = F.coalesce(size, F.lit(0)) == 0
    tied = F.transform("tie", lambda a: F.when(a < 0, F.lit(0.0)).when(bare, F.get(w, a)).otherwise(_dot(data, w, a.cast("bigint"), size)))
    basis = F.col("rbf_n") * (1 + size)  # weights of an entry: alphas, then centers
    distance = lambda e, n: F.aggregate(F.zip_with(data, F.slice(w, e * basis + F.col("rbf_n") + n * size + 1, size), lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x)
    rbf = F.transform(entries, lambda e: F.aggregate(F.transform(F.sequence(F.lit(0), F.col("rbf_n") - 1), lambda n: F.get(w, (e * basis + n).cast("int")) * F.exp(-F.exp("log_beta") * distance(e, n))), F.lit(0.0), lambda a, x: a + x))
    energies = F.when(F.col("kind") == "tied", tied).when(F.col("kind") == "rbf", rbf).when((F.col("kind") == "linear") & ~bare, linear).otherwise(table)
    return rows.withColumn("energies", energies).select(*[c for c in factor.columns if c != "cards"], "cards", "energies")


def energy_rows(tables: DataFrame) -> DataFrame:
    """graph_id, factor_id, ei, energy from energy_tables()."""
    return tables.select("graph_id", "factor_id", F.posexplode("energies").alias("ei", "energy")).withColumn("ei", F.col("ei").cast("bigint"))


def factor_states(scope: DataFrame, states: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """The table index that a labeling picks in each factor: keys, factor_id, ei."""
    return scope.join(states, ["graph_id", "var_id"]).groupBy(*dict.fromkeys(["graph_id", *keys]), "factor_id").agg(F.sum(F.col("stride") * F.col("state")).alias("ei"))


def labeling_energy(energy: DataFrame, scope: DataFrame, states: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """Energy of each labeling (one per graph, or per further keys such as sample_id)."""
    keys = tuple(dict.fromkeys(["graph_id", *keys]))
    return factor_states(scope, states, keys).join(energy, ["graph_id", "factor_id", "ei"]).groupBy(*keys).agg(F.sum("energy").alias("energy"))


def expected_energy(energy: DataFrame, marginal: DataFrame) -> DataFrame:
    """Energy expected under factor marginals, per graph."""
    return energy.join(marginal, ["graph_id", "factor_id", "ei"]).groupBy("graph_id").agg(F.sum(F.col("p") * F.col("energy")).alias("energy"))


def site_energies(tables: DataFrame, states: DataFrame) -> DataFrame:
    """For each variable and each of its states the energy of its factors, the others as in the labeling (graph_id, var_id, state).

    graph_id, var_id, s, energy; tables: from energy_tables(), or with `cards`. A factor's states are brought to its row
    once, and all of its sites are looked up in its own table; only the factors at a variable are looked at, so a changed
    site costs its neighbours. Factors with a variable that has no state are left out.
    """
    keys = ["graph_id", "factor_id"]
    at = tables.select(*keys, "cards", "energies", F.posexplode("vars").alias("pos", "var_id")).join(states.select("graph_id", "var_id", "state"), ["graph_id", "var_id"])
    row = F.sort_array(F.collect_list(F.struct("pos", "var_id", "state"))).alias("x")
    whole = at.groupBy(*keys).agg(F.first("cards").alias("cards"), F.first("energies").alias("energies"), row).where(F.size("x") == F.size("cards"))
    whole = whole.withColumn("k", strides(F.col("cards"))).withColumn("ei", F.aggregate(F.zip_with("x", "k", lambda x, k: x["state"] * k), F.lit(0).cast("bigint"), lambda a, y: a + y))

    def site(x: Column, i: Column) -> Column:
        k, ei = F.get("k", i), F.col("ei")
        return F.transform(F.sequence(F.lit(0), F.get("cards", i) - 1), lambda s: F.struct(x["var_id"].alias("var_id"), s.alias("s"), F.get("energies", (ei + (s - x["state"]) * k).cast("int")).alias("energy")))

    each = whole.select("graph_id", F.explode(F.flatten(F.transform("x", site))).alias("c"))
    return each.groupBy("graph_id", "c.var_id", "c.s").agg(F.sum("c.energy").alias("energy"))


def site_change(tables: DataFrame, states: DataFrame, changed: DataFrame) -> DataFrame:
    """graph_id, var_id, s, change: what the energy gains if one variable alone goes to another state; changed: graph_id, var_id, s."""
    near = tables.join(tables.select("graph_id", "factor_id", F.explode("vars").alias("var_id")).join(changed, ["graph_id", "var_id"]).select("graph_id", "factor_id").distinct(), ["graph_id", "factor_id"])
    sites = site_energies(near, states)
    now = sites.join(states.withColumnRenamed("state", "s"), ["graph_id", "var_id", "s"]).select("graph_id", "var_id", F.col("energy").alias("now"))
    return changed.join(sites, ["graph_id", "var_id", "s"]).join(now, ["graph_id", "var_id"]).select("graph_id", "var_id", "s", (F.col("energy") - F.col("now")).alias("change"))


def observed_energy(energy: DataFrame, scope: DataFrame, states: DataFrame, marginal: DataFrame) -> DataFrame:
    """graph_id, energy: of the labeling where a graph has states, else expected under its factor marginals."""
    labeled = labeling_energy(energy, scope, states)
    expected = expected_energy(energy, marginal.join(states.select("graph_id").distinct(), "graph_id", "left_anti"))
    return labeled.unionByName(expected)


def weight_gradient(factor: DataFrame, marginal: DataFrame, factor_type: DataFrame) -> DataFrame:
    """type, k, g: sum over factors of the marginal times the slope of the energy in each weight.

    Tables: the marginal itself; linear: times the data; tied: by tie; rbf: the slopes in amplitudes and centers, and in
    log_beta as k = -1. Sums combine before the shuffle, whose rows are then at most the weights of all types per task.
    """
    t = factor_type.select(F.col("name").alias("type"), "kind", "data_size", "tie", "w", "rbf_n", "log_beta")
    cells = marginal.join(factor.join(t, "type"), ["graph_id", "factor_id"])
    slot = F.when(F.col("kind") == "tied", F.get("tie", F.col("ei").cast("int")).cast("bigint")).otherwise(F.col("ei"))
    cells = cells.withColumn("slot", slot).where("slot >= 0").withColumn("size", F.greatest(F.coalesce("data_size", F.lit(0)), F.lit(1)).cast("bigint"))
    bare = F.coalesce(F.col("data_size"), F.lit(0)) == 0
    sparse = F.coalesce(F.size("data_idx") > 0, F.lit(False))
    at = F.col("slot") * F.col("size")
    pairs = F.when(F.col("kind") == "rbf", _rbf_slopes()).when(bare, F.array(F.struct(at.alias("k"), F.lit(1.0).alias("x"))))
    pairs = pairs.when(sparse, F.zip_with("data_idx", "data", lambda d, x: F.struct((at + d).alias("k"), x.alias("x"))))
    pairs = pairs.otherwise(F.transform("data", lambda x, d: F.struct((at + d).alias("k"), x.alias("x"))))
    each = cells.select("type", "p", F.explode(pairs).alias("f"))
    return each.groupBy("type", F.col("f.k").alias("k")).agg(F.sum(F.col("p") * F.col("f.x")).alias("g"))


def _rbf_slopes() -> Column:
    """Array of struct(k, x): slopes of sum alpha exp(-exp(beta) |data - center|^2) at the row's entry `slot`."""
    n, size, w, data = F.col("rbf_n").cast("bigint"), F.col("data_size").cast("bigint"), F.col("w"), F.col("data")
    first, beta = F.col("slot") * n * (1 + size), F.exp("log_beta")
    weight = lambda i: F.get(w, i.cast("int"))
    center = lambda i: first + n + i * size
    square = lambda i: F.aggregate(F.zip_with(data, F.slice(w, (center(i) + 1).cast("int"), size.cast("int")), lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x)
    found = lambda i: F.struct(i.alias("i"), square(i).alias("q"), F.exp(-beta * square(i)).alias("v"), weight(first + i).alias("alpha"))
    of = lambda k, x: F.struct(k.cast("bigint").alias("k"), x.alias("x"))

    def each(b: Column) -> Column:
        own = F.array(of(first + b["i"], b["v"]), of(F.lit(-1), -b["alpha"] * beta * b["q"] * b["v"]))
        return F.concat(own, F.transform(data, lambda x, d: of(center(b["i"]) + d, 2 * b["alpha"] * beta * b["v"] * (x - weight(center(b["i"]) + d)))))

    return F.flatten(F.transform(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), found), each))


def violations(factor: DataFrame, variable: DataFrame, factor_type: DataFrame, max_data: float = 1e4, states: DataFrame | None = None) -> DataFrame:
    """graph_id, factor_id, var_id, problem: what a validator has to say about the tables."""
    t = factor_type.select(F.col("name").alias("type"), "kind", F.col("card").alias("cards"), "prod_card", "data_size", "w")
    none = F.lit(None).cast("int")
    typed = factor.drop("cards").join(t, "type", "left")
    bare, sparse = F.coalesce(F.col("data_size"), F.lit(0)) == 0, F.col("data_idx").isNotNull()
    free = F.col("kind").isin("table", "linear")
    weights = F.coalesce(F.size("w"), F.lit(0))
    tables = bare & free & (weights <= 0)
    types = F.when(free & ~bare & (weights != F.col("prod_card") * F.col("data_size")) | free & bare & (weights > 0) & (weights != F.col("prod_card")), F.lit("number of weights"))
    sizes = F.when(tables & ~sparse & (F.size("data") != F.col("prod_card")), F.lit("size of the energy table")).when(~bare & ~sparse & (F.size("data") != F.col("data_size")), F.lit("number of data"))
    empty = F.when(sparse & (F.size("data") <= 0), F.lit("empty sparse data")).when(sparse & (F.size("data") != F.size("data_idx")), F.lit("number of data"))
    zipped = F.arrays_zip(F.col("vars").alias("var_id"), F.coalesce("cards", F.expr("cast(array() as array<int>)")).alias("needed"))
    at = typed.select("graph_id", "factor_id", F.explode(zipped).alias("x")).select("graph_id", "factor_id", "x.var_id", "x.needed").where("var_id is not null").join(variable, ["graph_id", "var_id"], "left")
    out = [
        typed.where(F.col("cards").isNull()).select("graph_id", "factor_id", none.alias("var_id"), F.lit("unknown type").alias("problem")),
        typed.where(F.size("vars") != F.size("cards")).select("graph_id", "factor_id", none, F.lit("number of variables")),
        at.where(F.col("card").isNull()).select("graph_id", "factor_id", "var_id", F.lit("unknown variable")),
        at.where(F.col("needed") != F.col("card")).select("graph_id", "factor_id", "var_id", F.lit("cardinality")),
        factor.where(F.exists("data", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).select("graph_id", "factor_id", none, F.lit("data not finite")),
        factor.where(F.exists("data", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")) & (F.abs(x) >= max_data))).select("graph_id", "factor_id", none, F.lit("data very large")),
        variable.join(at.select("graph_id", "var_id").distinct(), ["graph_id", "var_id"], "left_anti").select("graph_id", none.alias("factor_id"), "var_id", F.lit("isolated variable").alias("problem")).select("graph_id", "factor_id", "var_id", "problem"),
    ]
    out += [typed.withColumn("problem", p).where("problem is not null").select("graph_id", "factor_id", none.alias("var_id"), "problem") for p in (types, sizes, empty)]
    if states is not None:
        off = states.join(variable, ["graph_id", "var_id"]).where("state < 0 or state >= card")
        out.append(off.select("graph_id", none.alias("factor_id"), "var_id", F.lit("state out of range").alias("problem")))
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found
