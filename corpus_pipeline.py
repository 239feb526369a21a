"""A corpus pipeline over `documents`: toxicity, near copies, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fgspark.llm import packing, pii, shingle_copies, suffix, toxicity
from fgspark.llm.common import table, written
from fgspark.llm.queries import PII_KEY


def _sized(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is one, as the text's length."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the tagger stay."""
    tagger = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = docs.withColumn("__score", toxicity.score_column(docs, tagger, spans=False))
    return scored.where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: SimHash fingerprints at most 4 bits apart
    link, as in op3, and so do shingle sets of a similarity of 0.8 or more."""
    return shingle_copies.one_of_each(docs, radius=4)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that repeat stay where they come first."""
    return _sized(suffix.without_later_copies(docs))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format."""
    columns = docs.columns
    return _sized(pii.pseudonymise(docs, PII_KEY)).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix", drop_repeats),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: SQL expresses neither the tagger nor suffix order nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each but the last is written to the shared checkpoint folder and read again, in the place of the
    one before."""
    docs, before = table(spark, sf_dir, "documents"), ()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), instead_of=before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
