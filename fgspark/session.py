"""Checkpoints and intermediate folders of the library's own iterations."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a temporary folder if driver and executors are one process
    (tests), else an error: executors of a cluster share no local folder."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not place and not context.isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="fgspark-"))
    return context.getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the folder of checkpoints."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own under that of checkpoints, deleted at the end."""
    place = f"{checkpoint_folder(spark)}/folder-{uuid.uuid4()}"
    try:
        yield place
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
