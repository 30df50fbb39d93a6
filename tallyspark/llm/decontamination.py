"""Benchmark decontamination: find passages of test items in documents.

The normalised n-grams of the benchmark are hashed into a set that is sent to
every executor; documents are scanned window by window, and each hit of the
set is verified word by word. Benchmarks are small; one whose texts exceed
``BLOCK_BYTES`` is dealt into blocks below that bound, and the documents are
scanned once per block, so what is broadcast never exceeds it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import slices

WINDOW = 10
#: Bytes of benchmark text whose n-grams are broadcast at a time.
BLOCK_BYTES = 16_000_000
#: A word is a run of digits, letters a-z and everything beyond ASCII, after A-Z are lower-cased.
_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")
HITS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("word", "words", "byte", "bytes")]),
    False,
)
_ARROW_HITS = pa.list_(pa.struct([(n, pa.int64()) for n in ("word", "words", "byte", "bytes")]))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Grams:
    """The n-grams of benchmark items: a sorted array of hashes, and each n-gram's items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids: dict[bytes, int] = {}
        self.items: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            found = [self.ids.setdefault(w, len(self.ids)) for w in words(text)]
            size = min(window, len(found))
            for i in range(len(found) - size + 1 if size else 0):
                self.items[size][tuple(found[i : i + size])].add(item)
        self.items = {size: dict(grams) for size, grams in self.items.items()}
        self.hashes = {
            size: np.unique(self.hashed(np.array(list(grams), dtype=np.uint64)))
            for size, grams in self.items.items()
        }

    @staticmethod
    def hashed(grams: np.ndarray) -> np.ndarray:
        total = np.zeros(len(grams), dtype=np.uint64)
        for column in grams.T:
            total = (total ^ (column + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        return total

    def find(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """Occurrences (position, size, items) in the word ids of several documents.

        Words that no item has are -1; ``ends`` holds where each document ends.
        """
        found = []
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for size, grams in self.items.items():
            if len(ids) < size:
                continue
            start = np.flatnonzero(known[size:] - known[:-size] == size)
            start = start[start + size <= ends[np.searchsorted(ends, start, side="right")]]
            if not len(start):
                continue
            rows = ids[start[:, None] + np.arange(size)]
            hashes = self.hashed(rows.astype(np.uint64))
            sorted_hashes = self.hashes[size]
            at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
            for i in np.flatnonzero(sorted_hashes[at] == hashes).tolist():
                items = grams.get(tuple(rows[i].tolist()))
                if items:
                    found.append((int(start[i]), size, items))
        return found


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (first, end) spans, in order."""
    merged: list[list[int]] = []
    for first, end in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([first, end])
    return [(a, b) for a, b in merged]


def _blocks(benchmark: DataFrame) -> int:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-size // BLOCK_BYTES))


def mark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: Sequence[str] | None = None
) -> DataFrame:
    """Add n_words, hits and item_ids to documents.

    ``hits`` are the runs of words that lie inside an occurrence of an n-gram
    of an item, as word position and count and as byte position and count in
    the UTF-8 text; ``item_ids`` (strings, sorted, distinct) the items with
    such n-grams. An item of fewer than ``window`` words is one n-gram; one
    without words, or with a null text or id, is none. A null text has no
    words. ``keep`` names the columns to return besides (all by default);
    columns of the added names are replaced. Repeated rows are marked alike.
    """
    added = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", HITS),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
    names = {f.name for f in added}
    docs = docs.drop(*names)
    kept = [f for f in docs.schema if keep is None or f.name in keep]
    inner = docs if keep is None else docs.select(*dict.fromkeys([*(f.name for f in kept), "text"]))
    spark, count = docs.sparkSession, _blocks(benchmark)
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    for block in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        items = [(r[0], r[1]) for r in part.select(F.col("item_id").cast("string"), "text").collect()]
        sent = spark.sparkContext.broadcast(items)
        last = block == count - 1
        fields = [*(kept if last else inner.schema.fields if not block else inner.schema.fields[:-3]), *added]
        inner = inner.mapInArrow(_scanner(sent, window, [f.name for f in fields[:-3]]), T.StructType(fields))
    return inner


def _scanner(sent, window: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(sent.value, window)
        lookup = grams.ids
        for batch in slices(batches, "text"):
            split = [words(t) for t in batch.column("text").to_pylist()]
            counts = np.array([len(x) for x in split], dtype=np.int64)
            ends = np.cumsum(counts)
            every = chain.from_iterable(split)
            ids = np.fromiter((lookup.get(w, -1) for w in every), dtype=np.int64, count=int(counts.sum()))
            spans: dict[int, list] = defaultdict(list)
            items: dict[int, set] = defaultdict(set)
            for start, size, names in grams.find(ids, ends):
                row = int(np.searchsorted(ends, start, side="right"))
                first = start - int(ends[row] - counts[row])
                spans[row].append((first, first + size))
                items[row] |= names
            for name, store in (("hits", spans), ("item_ids", items)):
                if name in batch.schema.names:  # found by an earlier block of the benchmark
                    for row, old in enumerate(batch.column(name).to_pylist()):
                        for x in old or ():
                            if name == "hits":
                                store[row].append((x["word"], x["word"] + x["words"]))
                            else:
                                store[row].add(x)
            hits = []
            for row in range(batch.num_rows):
                runs = _runs(spans.get(row, []))
                if runs:
                    text = batch.column("text")[row].as_py().encode("utf-8", "surrogatepass")
                    at = [m.span() for m in _WORD.finditer(text.translate(_KEEP))]
                    runs = [(a, b - a, at[a][0], at[b - 1][1] - at[a][0]) for a, b in runs]
                hits.append([dict(zip(("word", "words", "byte", "bytes"), r, strict=True)) for r in runs])
            columns = [
                pa.array(counts, pa.int64()),
                pa.array(hits, _ARROW_HITS),
                pa.array([sorted(items.get(r, ())) for r in range(batch.num_rows)], pa.list_(pa.string())),
            ]
            old = [batch.column(n) for n in keep]
            yield pa.RecordBatch.from_arrays([*old, *columns], [*keep, "n_words", "hits", "item_ids"])

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW
) -> DataFrame:
    """Remove hit documents, or with ``remove="spans"`` the hit words from their texts.

    Returns the columns it got; clean documents are returned as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove}")
    columns, ours = docs.columns, ("n_words", "hits", "item_ids")
    hidden = {c: f"kept_{i}_{c}" for i, c in enumerate(columns) if c in ours}
    marked = mark(docs.withColumnsRenamed(hidden), benchmark, window)
    if remove == "documents":
        marked = marked.where(F.size("hits") == 0)
    else:
        marked = marked.withColumn("text", F.when(F.size("hits") == 0, F.col("text")).otherwise(_without()))
    return marked.drop(*ours).withColumnsRenamed({v: k for k, v in hidden.items()}).select(*columns)


def _without():
    """The text without its hits; spans begin and end at whole characters."""
    data = F.encode("text", "UTF-8")
    state = F.struct(F.lit(1).cast("long").alias("at"), F.lit("").cast("binary").alias("kept"))
    cut = F.aggregate(
        F.col("hits"),
        state,
        lambda s, h: F.struct(
            (h.byte + h.bytes + 1).alias("at"),
            F.concat(
                s["kept"],
                F.substring(data, s["at"].cast("int"), (h.byte + 1 - s["at"]).cast("int")),
            ).alias("kept"),
        ),
    )
    rest = F.substring(data, cut["at"].cast("int"), F.length(data))
    return F.concat(cut["kept"], rest).cast("string")
