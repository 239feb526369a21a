"""Extension: running counts of a stream as energies of a factor. Each batch adds to a table that all readers see whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_stream(rows: DataFrame, columns: list[str], folder: str, checkpoint: str):
    """Starts a query that writes each batch's counts of the joint states to folder/batch=<id>; a batch done anew after a
    failure writes the same folder again. rows: a streaming DataFrame."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*columns).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.select(*columns).writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)


def energies(spark, folder: str, columns: list[str]) -> DataFrame:
    """The joint states seen so far with n and the energy -ln n."""
    counts = spark.read.parquet(folder).groupBy(*columns).agg(F.sum("n").alias("n"))
    return counts.withColumn("energy", -F.log(F.col("n").cast("double")))
