"""Reading and writing of factor graph energies as text, and of graph tables as Parquet or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(tables: DataFrame, variable: DataFrame) -> DataFrame:
    """graph_id, text: the number of variables, their cardinalities, the number of factors, then for each factor how many
    variables it has, the variables from 1, and its energies, the first variable fastest."""
    cards = variable.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("var_id", "card"))).alias("v"))
    number: Column = F.transform("energies", lambda e: F.format_string("%10.10f", e))
    factor = F.concat(F.size("vars").cast("string"), F.lit(" "), F.array_join(F.transform("vars", lambda v: (v + 1).cast("string")), " "), F.lit("\n"), F.array_join(number, " "))
    rows = tables.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("factor_id", factor.alias("text")))).alias("f"))
    head = F.concat(F.size("v").cast("string"), F.lit("\n"), F.array_join(F.transform("v", lambda x: x["card"].cast("string")), " "), F.lit("\n"), F.size("f").cast("string"), F.lit("\n"))
    return cards.join(rows, "graph_id").select("graph_id", F.concat(head, F.array_join(F.transform("f", lambda x: x["text"]), "\n"), F.lit("\n")).alias("text"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variable, factor with energies) of files written by lines(), a graph per file, numbered by path."""
    files = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("graph_id"), F.transform(F.filter(F.split("value", r"\s+"), lambda x: F.length(x) > 0), lambda x: x.cast("double")).alias("x"))
    n = F.col("x")[0].cast("int")
    cards = F.transform(F.slice("x", F.lit(2), n), lambda c: c.cast("int"))
    variable = files.select("graph_id", F.posexplode(cards).alias("var_id", "card"))

    def step(state: Column, i: Column) -> Column:
        k = F.get("x", state["at"]).cast("int")
        scope = F.transform(F.slice("x", state["at"] + 2, k), lambda v: v.cast("int") - 1)
        size = F.aggregate(scope, F.lit(1), lambda a, v: a * F.get(state["cards"], v))
        row = F.struct(i.alias("factor_id"), scope.alias("vars"), F.slice("x", state["at"] + 2 + k, size).alias("energies"))
        return F.struct((state["at"] + 1 + k + size).alias("at"), state["cards"].alias("cards"), F.concat(state["rows"], F.array(row)).alias("rows"))

    start = F.struct((n + 2).alias("at"), cards.alias("cards"), F.expr("cast(array() as array<struct<factor_id:int,vars:array<int>,energies:array<double>>>)").alias("rows"))
    count = F.get("x", n + 1).cast("int")
    parsed = files.withColumn("rows", F.aggregate(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)")), start, step, lambda s: s["rows"]))
    return variable, parsed.select("graph_id", F.explode("rows").alias("r")).select("graph_id", "r.*")


def listing(scope: DataFrame, variable: DataFrame) -> DataFrame:
    """graph_id, kind, number, line: a line for each variable with its factors and for each factor with its variables."""
    text = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x.cast("string")), " ")
    of = scope.groupBy("graph_id", "var_id").agg(text(F.collect_set("factor_id")).alias("l"))
    found = variable.join(of, ["graph_id", "var_id"], "left")
    line = F.concat(F.lit("variable "), F.col("var_id").cast("string"), F.lit(" ("), F.col("card").cast("string"), F.lit(" states): factors "), F.coalesce("l", F.lit("none")))
    variables = found.select("graph_id", F.lit("variable").alias("kind"), F.col("var_id").alias("number"), line.alias("line"))
    in_order = scope.groupBy("graph_id", "factor_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "var_id"))), lambda x: x["var_id"].cast("string")), " ").alias("l"))
    factors = in_order.select("graph_id", F.lit("factor").alias("kind"), F.col("factor_id").alias("number"), F.concat(F.lit("factor "), F.col("factor_id").cast("string"), F.lit(": variables "), "l").alias("line"))
    return variables.unionByName(factors)


def save(frames: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each table to a folder of its name."""
    for name, df in frames.items():
        df.write.mode("overwrite").format(kind).save(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, schemas: dict[str, str], kind: str = "parquet") -> dict[str, DataFrame]:
    return {name: spark.read.schema(s).format(kind).load(f"{folder}/{name}") for name, s in schemas.items()}
