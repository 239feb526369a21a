"""Conditioning: graphs given the states of some variables, or beliefs about them, and the way back to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import digit

STATES, BELIEFS = "graph_id bigint, var_id int, state int", "graph_id bigint, var_id int, s int, p double"


def _given(scope: DataFrame, observed: DataFrame | None, beliefs: DataFrame | None) -> DataFrame:
    """graph_id, factor_id, s: of each factor's positions (pos, var_id, card, stride, known, probs by state).

    An observed state is the belief that holds it with 1; it goes before other beliefs. Of a believed variable, states
    without a row have 0.
    """
    spark = scope.sparkSession
    observed = spark.createDataFrame([], STATES) if observed is None else observed
    beliefs = spark.createDataFrame([], BELIEFS) if beliefs is None else beliefs
    sure = observed.select("graph_id", "var_id", F.col("state").alias("s"), F.lit(1.0).alias("p"))
    both = sure.unionByName(beliefs.join(observed, ["graph_id", "var_id"], "left_anti").select("graph_id", "var_id", "s", "p"))
    listed = both.groupBy("graph_id", "var_id").agg(F.collect_list(F.struct("s", "p")).alias("probs"))
    return scope.join(listed, ["graph_id", "var_id"], "left").groupBy("graph_id", "factor_id").agg(F.sort_array(F.collect_list(F.struct("pos", "var_id", "card", "stride", "probs"))).alias("s"))


def _weight(ei: Column) -> Column:
    """The product over the known positions of what is believed of the cell's state."""
    of = lambda x: F.aggregate(x["probs"], F.lit(0.0), lambda a, b: a + F.when(b["s"] == digit(ei, x["stride"], x["card"]), b["p"]).otherwise(F.lit(0.0)))
    return F.aggregate(F.filter("s", lambda x: x["probs"].isNotNull()), F.lit(1.0), lambda a, x: a * of(x))


def _index(ei: Column, free: bool) -> Column:
    """The cell's index over the free (or the known) positions alone, the first fastest."""
    start = F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(1).cast("bigint").alias("k"))
    part = F.filter("s", lambda x: x["probs"].isNull() if free else x["probs"].isNotNull())
    return F.aggregate(part, start, lambda a, x: F.struct((a["i"] + digit(ei, x["stride"], x["card"]) * a["k"]).alias("i"), (a["k"] * x["card"]).alias("k")), lambda a: a["i"])


def _n_free() -> Column:
    return F.size(F.filter("s", lambda x: x["probs"].isNull()))


def condition_on_states(energy: DataFrame, scope: DataFrame, observed: DataFrame) -> DataFrame:
    """Tables of the factors with a free variable, cut to the observed states: graph_id, factor_id, ei, new_ei, energy.

    new_ei counts over the free variables only. Factors without a free one are left out; observed_constant() has what
    they add.
    """
    cells = energy.join(_given(scope, observed, None), ["graph_id", "factor_id"]).where(_n_free() > 0)
    return cells.where(_weight(F.col("ei")) > 0).select("graph_id", "factor_id", "ei", _index(F.col("ei"), True).alias("new_ei"), "energy")


def observed_constant(energy: DataFrame, scope: DataFrame, observed: DataFrame | None = None, beliefs: DataFrame | None = None) -> DataFrame:
    """graph_id, energy: what the factors without a free variable add to every labeling."""
    cells = energy.join(_given(scope, observed, beliefs), ["graph_id", "factor_id"]).where(_n_free() == 0)
    return cells.groupBy("graph_id").agg(F.sum(_weight(F.col("ei")) * F.col("energy")).alias("energy"))


def condition_on_beliefs(energy: DataFrame, scope: DataFrame, beliefs: DataFrame | None, observed: DataFrame | None = None) -> DataFrame:
    """Expected tables over the free variables, where beliefs (graph_id, var_id, s, p) and observed states replace the
    others: graph_id, factor_id, new_ei, energy. A cell of weight 0 adds nothing, whatever its energy."""
    cells = energy.join(_given(scope, observed, beliefs), ["graph_id", "factor_id"]).where(_n_free() > 0)
    weight = _weight(F.col("ei"))
    part = F.when(weight == 0, F.lit(0.0)).otherwise(weight * F.col("energy"))
    return cells.groupBy("graph_id", "factor_id", _index(F.col("ei"), True).alias("new_ei")).agg(F.sum(part).alias("energy"))


def conditioned_graph(tables: DataFrame, variable: DataFrame, observed: DataFrame | None = None, beliefs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The graph of the free variables, ready for inference.

    variable (graph_id, var_id, card) and tables (graph_id, factor_id, vars, cards, energies) count free variables and
    the factors that have one anew from 0; var_map and factor_map give the old numbers (old_var_id, old_factor_id);
    constant (graph_id, energy) is what the left-out factors add. tables: graph_id, factor_id, vars, energies.
    """
    from .energies import energy_rows, scopes

    scope, energy = scopes(tables, variable), energy_rows(tables)
    known = None
    for part in (observed, beliefs):
        if part is not None:
            ids = part.select("graph_id", "var_id").distinct()
            known = ids if known is None else known.unionByName(ids)
    rest = variable if known is None else variable.join(known, ["graph_id", "var_id"], "left_anti")
    number = lambda df, c: df.withColumn("new", F.row_number().over(Window.partitionBy("graph_id").orderBy(c)) - 1)
    var_map = number(rest, "var_id").select("graph_id", F.col("new").alias("var_id"), F.col("var_id").alias("old_var_id"), "card")
    free = scope.join(var_map.select("graph_id", F.col("old_var_id").alias("var_id"), F.col("var_id").alias("new")), ["graph_id", "var_id"])
    shape = free.groupBy("graph_id", "factor_id").agg(F.sort_array(F.collect_list(F.struct("pos", "new", "card"))).alias("x"))
    factor_map = number(shape.select("graph_id", "factor_id"), "factor_id")
    cut = condition_on_beliefs(energy, scope, beliefs, observed)
    listed = cut.groupBy("graph_id", "factor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("new_ei", "energy"))), lambda x: x["energy"]).alias("energies"))
    made = listed.join(shape, ["graph_id", "factor_id"]).join(factor_map, ["graph_id", "factor_id"])
    return {
        "variable": var_map.select("graph_id", "var_id", "card"),
        "tables": made.select("graph_id", F.col("new").alias("factor_id"), F.transform("x", lambda x: x["new"]).alias("vars"), F.transform("x", lambda x: x["card"]).alias("cards"), "energies"),
        "var_map": var_map.select("graph_id", "var_id", "old_var_id"),
        "factor_map": factor_map.select("graph_id", F.col("new").alias("factor_id"), F.col("factor_id").alias("old_factor_id")),
        "constant": observed_constant(energy, scope, observed, beliefs),
    }


def extend_marginals(marginal: DataFrame, energy: DataFrame, scope: DataFrame, observed: DataFrame | None = None, beliefs: DataFrame | None = None, replicate: bool = False) -> DataFrame:
    """Marginals over whole tables: graph_id, factor_id, ei, p, from those over the free variables (ei counts as new_ei).

    A cell has its free part's marginal times what is believed of its known part, so mass stands at the observed states;
    replicate: times 1. Factors without a free variable have the belief itself. marginal has the old factor numbers.
    """
    cells = energy.select("graph_id", "factor_id", "ei").join(_given(scope, observed, beliefs), ["graph_id", "factor_id"])
    weight = F.lit(1.0) if replicate else _weight(F.col("ei"))
    cells = cells.select("graph_id", "factor_id", "ei", weight.alias("w"), F.when(_n_free() > 0, _index(F.col("ei"), True)).alias("new_ei"))
    found = cells.join(marginal.select("graph_id", "factor_id", F.col("ei").alias("new_ei"), "p"), ["graph_id", "factor_id", "new_ei"], "left")
    one = F.when(F.col("new_ei").isNull(), F.lit(1.0)).otherwise(F.coalesce("p", F.lit(0.0)))
    return found.select("graph_id", "factor_id", "ei", (one * F.col("w")).alias("p"))


def project_known(extended: DataFrame, scope: DataFrame, observed: DataFrame | None = None, beliefs: DataFrame | None = None) -> DataFrame:
    """graph_id, factor_id, cond_ei, p: the value of extended tables by the state of the known part, which the free part
    must not change; of unequal ones that of the smallest ei."""
    cells = extended.join(_given(scope, observed, beliefs), ["graph_id", "factor_id"]).where(F.size("s") > _n_free())
    return cells.groupBy("graph_id", "factor_id", _index(F.col("ei"), False).alias("cond_ei")).agg(F.min_by("p", "ei").alias("p"))


def conditioned_types(factor: DataFrame, known: DataFrame) -> DataFrame:
    """type, known_pos, n: the conditioned types that a graph needs, one for each type and set of known positions (some
    known, some free), and how many factors have it."""
    at = factor.select("graph_id", "factor_id", "type", F.size("vars").alias("size"), F.posexplode("vars").alias("pos", "var_id"))
    marked = at.join(known.select("graph_id", "var_id").distinct(), ["graph_id", "var_id"])
    kinds = marked.groupBy("graph_id", "factor_id", "type", "size").agg(F.sort_array(F.collect_list("pos")).alias("known_pos")).where(F.size("known_pos") < F.col("size"))
    return kinds.groupBy("type", "known_pos").agg(F.count("*").alias("n"))


def conditioned_gradient(factor: DataFrame, factor_type: DataFrame, marginal: DataFrame, energy: DataFrame, scope: DataFrame, observed: DataFrame | None = None, beliefs: DataFrame | None = None) -> DataFrame:
    """type, k, g of the base types' weights, from marginals over the free variables: extended, then mapped back."""
    from .energies import weight_gradient

    return weight_gradient(factor, extend_marginals(marginal, energy, scope, observed, beliefs), factor_type)
