"""Token counts: an exact histogram of encoded lengths and what follows from it.

Documents of one length are one row, however many there are. Sums over the
rows at or above a length answer, for every context limit at once, how many
documents and ids there are, how many are cut, and what is left after cutting.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, texts
from tallyspark.llm.encoding import encoder

#: Lengths per block of the two-level sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One column ``n_tokens`` per document; null and empty texts have 0 ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in slices(batches, "text"):
            counts = [len(packed) // 4 for packed in encode(texts(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs) from one row per document; null lengths are left out."""
    return (
        lengths.where(F.col("n_tokens").isNotNull())
        .groupBy("n_tokens")
        .agg(F.count(F.lit(1)).alias("docs"))
    )


def limits(hist: DataFrame) -> DataFrame:
    """Answers for each limit that is a length of the histogram.

    Columns: n_tokens (the limit), docs and tokens of that length,
    docs_at_least and tokens_at_least (suffix sums), docs_total, tokens_total,
    tokens_truncated (ids left when every document is cut at the limit), share
    (part of the documents that are no longer: the limit is their quantile of
    that order). Lengths are summed in blocks, so no task sees them all; what
    meets in one place is one row per block of lengths.
    """
    rows = hist.select(
        "n_tokens",
        "docs",
        (F.col("n_tokens") * F.col("docs")).alias("tokens"),
        F.floor(F.col("n_tokens") / BLOCK).alias("block"),
    )
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(every).alias("docs_total"),
        F.sum("t").over(every).alias("tokens_total"),
    )
    suffix = (
        Window.partitionBy("block")
        .orderBy(F.desc("n_tokens"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    docs_at_least = F.col("docs_above") + F.sum("docs").over(suffix)
    tokens_at_least = F.col("tokens_above") + F.sum("tokens").over(suffix)
    summed = rows.join(blocks, "block").select(
        "n_tokens",
        "docs",
        "tokens",
        docs_at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        "docs_total",
        "tokens_total",
    )
    cut = F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    below = F.col("docs_total") - F.col("docs_at_least") + F.col("docs")
    return summed.withColumns({"tokens_truncated": cut, "share": below / F.col("docs_total")})


def truncated_total(answers: DataFrame, limit: int) -> DataFrame:
    """Ids left when documents are cut at any ``limit``, one row; 0 for an empty table."""
    below = F.col("n_tokens") <= limit
    return answers.agg(
        F.coalesce(
            F.sum(F.when(below, F.col("tokens")).otherwise(F.col("docs") * limit)), F.lit(0)
        ).alias("tokens_truncated")
    )


def quantile(answers: DataFrame, order: float) -> DataFrame:
    """The smallest length that at least ``order`` of the documents do not exceed, one row."""
    return answers.where(F.col("share") >= order).agg(F.min("n_tokens").alias("n_tokens"))
