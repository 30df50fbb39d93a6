"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are the distinct words, pairs of neighbours and pairs
with one word between. The model is fitted on a bounded sample of labelled
rows, dealt into shards of bounded size that are fitted side by side; their
weights are averaged. L1 leaves few weights, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import slices
from tallyspark.llm.wordhash import forgetting, sequence_hashes, word_hashes

#: Labelled rows the model is fitted on at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000
SHARD_ROWS = 4_000
BITS = 20
BIAS = 1 << BITS
REJECT = 0.7
_WORD_BYTES = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Words at these distances form one feature.
SHAPES = ((0,), (0, 1), (0, 2))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_WORD_BYTES).split()


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per shape: the owner (number of the text) and the hash of every feature, repeats included."""
    hashes, counts = word_hashes([words(text) for text in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    for shape in SHAPES:
        reach = max(shape)
        found = (sequence_hashes(hashes, shape) >> np.uint64(64 - BITS)).astype(np.int64)
        inside = owner[: len(found)] == owner[reach:]
        yield owner[: len(found)][inside], found[inside]


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the per-coordinate learning rate and of both penalties.

    Rows of the rarer class weigh more, by the root of the classes' ratio, and
    features of fewer than ``least_rows`` rows are left out.
    """

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0
    passes: int = 6
    least_rows: int = 2

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
        """Weights with the bias last, zero where L1 holds."""
        z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
        seen = np.bincount(np.concatenate(rows), minlength=BIAS + 1)
        rows = [x[seen[x] >= self.least_rows] for x in rows]
        share = np.clip(labels.mean(), 1 / (len(labels) + 1), 1 - 1 / (len(labels) + 1))
        weight = np.where(labels > 0, max(1.0, ((1 - share) / share) ** 0.5), max(1.0, (share / (1 - share)) ** 0.5))
        order = np.random.default_rng(7)
        for _ in range(self.passes):
            for i in order.permutation(len(rows)).tolist():
                x = rows[i]
                root = np.sqrt(n[x])
                w = self._weights(z[x], root)
                g = weight[i] * (1 / (1 + np.exp(-w.sum())) - labels[i])
                z[x] += g - (np.sqrt(n[x] + g * g) - root) / self.alpha * w
                n[x] += g * g
        return self._weights(z, np.sqrt(n))

    def _weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + root) / self.alpha + self.l2)


@dataclass(frozen=True)
class ToxicityModel:
    hashes: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        full = np.zeros(BIAS + 1)
        full[self.hashes] = self.weights
        return full


def fit(docs: DataFrame, labels: DataFrame, ftrl: Ftrl | None = None) -> ToxicityModel:
    """Learn ``labels.toxic`` from the texts of ``docs`` with the same doc_id.

    Null labels are left out; of several labels of a document the highest
    holds. Without labelled rows all weights are 0 and every score a half.
    """
    ftrl = ftrl or Ftrl()
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    shards = max(1, -(-sample.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")
    # at most MAX_LABELLED pairs of numbers
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(key, table: pa.Table) -> pa.Table:
        rows: list[np.ndarray] = []
        for batch in slices(table.to_batches(), "text"):
            found = list(features(batch.column("text").to_pylist()))
            owner = np.concatenate([o for o, _ in found])
            hashed = np.concatenate([h for _, h in found])
            pairs = np.unique(owner << np.int64(BITS + 1) | hashed)
            cuts = np.searchsorted(pairs >> np.int64(BITS + 1), np.arange(1, batch.num_rows))
            rows += [np.append(x, BIAS) for x in np.split(pairs & np.int64((2 << BITS) - 1), cuts)]
        weights = ftrl.fit(rows, table.column("toxic").to_numpy())
        where = np.flatnonzero(weights)
        return pa.table({"hash": where, "weight": weights[where]})

    fitted = (
        chosen.select(shard.alias("shard"), "doc_id", "text", F.col("toxic").cast("double").alias("toxic"))
        .groupBy("shard")
        .applyInArrow(lambda key, t: run(key, t.sort_by("doc_id")), "hash long, weight double")
        .groupBy("hash")
        .agg((F.sum("weight") / shards).alias("weight"))
        .orderBy("hash")
        .toPandas()
    )
    return ToxicityModel(fitted["hash"].to_numpy(np.int64), fitted["weight"].to_numpy(float))


def with_scores(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """Documents with their score from 0 to 1 in column ``name``, which replaces one of that name.

    Whole texts are scored; null and empty ones get the score of no features.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value.dense()
        for batch in slices(batches, "text"):
            margin = np.full(batch.num_rows, weights[BIAS])
            for owner, hashed in features(batch.column("text").to_pylist()):
                hit = weights[hashed] != 0
                pairs = np.unique(owner[hit] << np.int64(BITS) | hashed[hit])
                margin += np.bincount(
                    pairs >> np.int64(BITS), weights[pairs & np.int64(BIAS - 1)], batch.num_rows
                )
            score = pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), score], [*columns, name]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(forgetting(run), schema)


def reject_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = REJECT) -> DataFrame:
    """Documents whose score is below ``threshold``, with the columns they came with."""
    name = "toxicity_score"
    while name in docs.columns:
        name += "_"
    return with_scores(docs, model, name).where(F.col(name) < threshold).drop(name)
