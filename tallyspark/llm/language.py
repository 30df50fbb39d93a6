"""Language identification by error-correcting output codes.

Each learned language has a codeword. One binary classifier per bit, naive
Bayes over hashed character n-grams, tells the languages whose bit is 1 from
those whose bit is 0. A text's language is the codeword of least loss, where
every bit's logistic loss counts by how well that bit separates the languages.
Training sums n-gram counts per language in Spark over all training rows; the
model holds one number per bit and hash, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices

BITS = 14
SHARPNESS = 6.0
#: Codewords of up to this many languages use every split of them.
EXHAUSTIVE = 5
UNDETERMINED = "und"
#: ASCII that is no letter becomes a space.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Hashes of the 3- and 4-byte n-grams of a text in lower case."""
    data = b" ".join([b"", *text.lower().encode("utf-8", "replace").translate(_LETTERS).split(), b""])
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.empty(0, np.int64)
    three = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    four = three[:-1] | x[3:] << np.uint32(24)
    hashed = np.concatenate([three * np.uint32(2654435761), (four ^ (four >> np.uint32(15))) * np.uint32(2246822519)])
    return (hashed >> np.uint32(32 - BITS)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(count: int) -> np.ndarray:
    """Codewords of +1 and -1, one row per language; columns hold both signs."""
    if count <= 1:
        return np.ones((count, 1))
    if count <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (count - 1))
        return np.where((splits >> np.arange(count)[:, None]) & 1, 1.0, -1.0)
    length = 4 * int(np.ceil(np.log2(count))) + 7
    best, distance = None, -1
    for seed in range(64):
        code = np.where(np.random.default_rng(seed).random((count, length)) < 0.5, -1.0, 1.0)
        if (np.abs(code.sum(axis=0)) == count).any():
            continue
        apart = length - (code @ code.T + length) / 2 + 2 * length * np.eye(count)
        if apart.min() > distance:
            best, distance = code, apart.min()
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    importance: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether two codewords are about as near."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        found = grams(text)
        counts = np.bincount(found, minlength=1 << BITS)
        margins = counts @ self.weights / max(1, len(found)) * SHARPNESS
        loss = np.logaddexp(0, -self.code * margins) @ self.importance
        order = np.argsort(loss, kind="stable")
        share = np.exp(SHARPNESS * (loss.min() - loss))
        score = float(share.max() / share.sum())
        return self.languages[order[0]], score, bool(loss[order[1]] - loss[order[0]] < 0.02)


def fit(training: DataFrame) -> LanguageModel:
    """Learn from ``text`` and ``lang``; rows with a null in either are left out.

    What reaches the driver is one count per language and hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            pairs = zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for lang, text in pairs:
                found = np.bincount(grams(text), minlength=1 << BITS)
                counts[lang] = counts[lang] + found if lang in counts else found
        for lang, found in counts.items():
            where = np.flatnonzero(found)
            columns = [pa.array([lang] * len(where), pa.string()), pa.array(where), pa.array(found[where])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "hash", "n"])

    known = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = (
        known.select("text", "lang")
        .mapInArrow(run, "lang string, hash long, n long")
        .groupBy("lang", "hash")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(sums["lang"].unique().tolist())
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((1 << BITS, 1)), np.ones(1))
    counts = np.zeros((len(languages), 1 << BITS))
    counts[[languages.index(x) for x in sums["lang"]], sums["hash"]] = sums["n"]
    # each language weighs the same, however many rows it has
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    if len(languages) == 1:
        return LanguageModel(languages, code, np.zeros((1 << BITS, 1)), np.ones(1))
    ones, zeros = (code > 0).T, (code < 0).T
    mean = [(g @ share) / g.sum(axis=1, keepdims=True) for g in (ones.astype(float), zeros.astype(float))]
    weights = np.log(mean[0] / mean[1]).T
    # a bit is as good as the language it tells apart worst
    worst = np.maximum((code * (share @ weights)).min(axis=0), 1e-3)
    return LanguageModel(languages, code, weights, worst / worst.sum())


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every whole text; reads nothing else.

    ``und`` with score 0 where the text is null, has no letter, or nothing was
    learned. Repeated rows get the same answer.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [sent.value.predict(text) for text in batch.column("text").to_pylist()]
            columns = [
                batch.column("doc_id"),
                pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()),
                pa.array([x[2] for x in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
