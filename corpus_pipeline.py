"""A corpus pipeline of five stages; each works on all that the one before kept.

Toxic documents go, one document of each group of near duplicates stays,
repeated byte strings are cut out of the texts, documents with passages of the
benchmark go, and the rest is packed into sequences. Every stage's result is
written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import decontamination, near_duplicates, packing, repeats, toxicity
from tallyspark.llm.common import remainder, small_batches, table
from tallyspark.session import materialise


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """A stage whose texts travel in Arrow batches of at most ``common.BATCH_BYTES``, or one row."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model learns from labels of two in three documents."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 3) != 1))
    return toxicity.reject_toxic(docs, model)


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more in five-word shingles."""
    return near_duplicates.drop_near_duplicates(docs, 5)


@in_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 200 bytes that start more than once."""
    return repeats.remove_repeats(docs, 200)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents", 10)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return packing.pack(docs, "byte_bpe_50k.json", 1024, 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained model and a tokenizer decide what stays, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``, after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
