"""Structure of factor graphs: neighbours, components, forests, grids, parts of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import elimination


def neighbours(scope: DataFrame) -> DataFrame:
    """graph_id, var_id, factors: the sorted factors of each variable."""
    return scope.groupBy("graph_id", "var_id").agg(F.sort_array(F.collect_set("factor_id")).alias("factors"))


def components(scope: DataFrame, variable: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """graph_id, var_id, component: the smallest variable that each one is connected to, without the removed factors.

    Labels fall along factors and are then shortened by looking up the label of the label, so the rounds grow with the
    logarithm of the longest path; each ends in a checkpoint.
    """
    edges = scope.select("graph_id", "factor_id", "var_id")
    if removed is not None:
        edges = edges.join(removed.select("graph_id", "factor_id"), ["graph_id", "factor_id"], "left_anti")
    label = cut_lineage(variable.select("graph_id", "var_id", F.col("var_id").alias("component")))
    while True:
        least = edges.join(label, ["graph_id", "var_id"]).groupBy("graph_id", "factor_id").agg(F.min("component").alias("m"))
        reach = edges.join(least, ["graph_id", "factor_id"]).groupBy("graph_id", "var_id").agg(F.min("m").alias("m"))
        moved = label.join(reach, ["graph_id", "var_id"], "left").select("graph_id", "var_id", F.col("component").alias("before"), F.least("component", F.coalesce("m", "component")).alias("c"))
        # a label's own label: hooks roots as well as leaves
        root = moved.groupBy("graph_id", F.col("before").alias("r")).agg(F.min("c").alias("rc"))
        root = root.withColumnRenamed("graph_id", "rg")
        hooked = moved.join(root, (F.col("graph_id") == F.col("rg")) & (F.col("c") == F.col("r")), "left").select("graph_id", "var_id", "before", F.least("c", F.coalesce("rc", "c")).alias("component"))
        after = cut_lineage(hooked)
        if not after.where("component <> before").limit(1).count():
            return after.drop("before")
        label = after.drop("before")


def shape(scope: DataFrame, variable: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """graph_id, n_components, is_connected, is_forest, is_tree: a forest has as many links as vertices beyond components."""
    if removed is not None:
        scope = scope.join(removed.select("graph_id", "factor_id"), ["graph_id", "factor_id"], "left_anti")
    parts = components(scope, variable).groupBy("graph_id").agg(F.countDistinct("component").alias("n_components"), F.count("*").alias("n"))
    links = scope.groupBy("graph_id", "factor_id").agg((F.count("*") - 1).alias("l")).groupBy("graph_id").agg(F.sum("l").alias("links"))
    forest = F.coalesce("links", F.lit(0)) == F.col("n") - F.col("n_components")
    one = F.col("n_components") == 1
    return parts.join(links, "graph_id", "left").select("graph_id", "n_components", one.alias("is_connected"), forest.alias("is_forest"), (one & forest).alias("is_tree"))


def grid_shape(scope: DataFrame) -> DataFrame:
    """graph_id, n_rows, n_columns of graphs whose pair factors form a grid in row-major order (others are left out).

    A grid of r x c has r c variables and 2 r c - r - c pairs, which fix r + c and r c; the pairs must be neighbours
    in a row or, c apart, in a column.
    """
    pairs = scope.groupBy("graph_id", "factor_id").agg(F.count("*").alias("k"), F.min("var_id").alias("a"), F.max("var_id").alias("b")).where("k = 2")
    sizes = scope.groupBy("graph_id").agg(F.countDistinct("var_id").alias("n"))
    found = pairs.groupBy("graph_id").agg(F.count("*").alias("m"), F.max(F.col("b") - F.col("a")).alias("step")).join(sizes, "graph_id")
    found = found.where((F.col("n") % F.col("step") == 0) & (F.col("m") == 2 * F.col("n") - F.col("step") - F.floor(F.col("n") / F.col("step"))))
    wrong = pairs.join(found, "graph_id").where(~((F.col("b") - F.col("a") == F.col("step")) | (F.col("b") - F.col("a") == 1) & (F.col("b") % F.col("step") != 0)))
    good = found.join(wrong.select("graph_id").distinct(), "graph_id", "left_anti")
    return good.select("graph_id", F.floor(F.col("n") / F.col("step")).cast("int").alias("n_rows"), F.col("step").alias("n_columns"))


def depths(scope: DataFrame, variable: DataFrame, finish: int | None = None) -> DataFrame:
    """graph_id, var_id, depth from the smallest variable of each component: messages go by falling depth.

    The rounds grow with the logarithm of a forest's size, not with its depth.
    """
    roots = components(scope, variable).where("component = var_id").select("graph_id", F.col("var_id").cast("bigint").alias("var_id"))
    # variables and factors (from -1 down) are the vertices, so a step from variable to variable has length 2
    links = scope.select("graph_id", F.col("var_id").cast("bigint").alias("a"), (-1 - F.col("factor_id").cast("bigint")).alias("b"), F.lit(0.5).alias("l"))
    found = elimination.distances(links, roots, elimination.FINISH if finish is None else finish)
    return found.where("var_id >= 0").select("graph_id", F.col("var_id").cast("int").alias("var_id"), F.col("d").cast("int").alias("depth"))


def sub_graph(tables: DataFrame, chosen: DataFrame) -> DataFrame:
    """The factors in `chosen` (graph_id, factor_id, scale), energies scaled and variables numbered anew from 0.

    tables: rows with graph_id, factor_id, vars, energies.
    """
    kept = tables.join(chosen, ["graph_id", "factor_id"])
    numbers = kept.select("graph_id", F.explode("vars").alias("var_id")).distinct().withColumn("new", F.row_number().over(Window.partitionBy("graph_id").orderBy("var_id")) - 1)
    at = kept.select("graph_id", "factor_id", F.posexplode("vars").alias("pos", "var_id")).join(numbers, ["graph_id", "var_id"])
    renamed = at.groupBy("graph_id", "factor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("vars"))
    return kept.drop("vars").join(renamed, ["graph_id", "factor_id"]).select("graph_id", "factor_id", "vars", F.transform("energies", lambda e: e * F.col("scale")).alias("energies"))


def ising(spark, n: int, k: float) -> tuple[DataFrame, DataFrame]:
    """(variable, factor with energies) of an n x n lattice with a helical border: site i joins i - 1 and i - n, modulo n^2."""
    sites = spark.range(n * n).select(F.col("id").cast("int").alias("i"))
    variable = sites.select(F.lit(0).cast("bigint").alias("graph_id"), F.col("i").alias("var_id"), F.lit(2).alias("card"))
    pair = lambda off, step: sites.select(F.lit(0).cast("bigint").alias("graph_id"), (F.col("i") + off).alias("factor_id"), F.array(F.pmod(F.col("i") - step, F.lit(n * n)), F.col("i")).alias("vars"))
    both = pair(0, 1).unionByName(pair(n * n, n))
    return variable, both.withColumn("energies", F.array(*[F.lit(float(x)) for x in (-k, k, k, -k)]))
