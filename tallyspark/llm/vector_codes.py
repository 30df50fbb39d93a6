"""Product codes of vectors, with integer codebooks searched through memoised grid cells.

A vector becomes integers and is cut into equal consecutive parts; each part
position has a codebook, and a part is coded by its nearest entry. The search
hashes the grid cell a part lies in. The first part seen in a cell finds the
entries that can be nearest to any point of the cell: an entry is out if its
least distance to the cell's box is above another entry's greatest distance.
The cell keeps that list, and only its entries are compared exactly, so
results equal those of a full search.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import ship
from tallyspark.session import materialise

#: Cells of one part position that a task keeps; when there are more, it starts anew.
KEPT_CELLS = 100_000
#: Vectors handled at a time inside a task.
ROWS = 8_192


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, index and position within the part, as 64-bit integers."""

    entries: np.ndarray
    scale: int

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of the decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class CellSearch:
    """Nearest entries of one codebook, ties to the lower index."""

    def __init__(self, entries: np.ndarray, most_cells: int = KEPT_CELLS):
        self.entries = entries
        self.most_cells = most_cells
        self.side = self._side(entries)
        self.cells: dict[bytes, np.ndarray] = {}

    @staticmethod
    def _side(entries: np.ndarray) -> int:
        """Edge of a cell: twice the typical distance of an entry to its nearest other one, along one axis."""
        if len(entries) < 2:
            return 1 << 40
        apart = ((entries[:, None] - entries[None]) ** 2).sum(2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        return max(1, int(2 * (float(np.median(apart.min(1))) / entries.shape[1]) ** 0.5))

    def candidates(self, low: np.ndarray) -> list[np.ndarray]:
        """Ascending indexes of the entries not dominated across the box at each cell's low corner."""
        found = []
        step = max(1, (1 << 18) // max(1, self.entries.size))
        for first in range(0, len(low), step):
            below = low[first : first + step, None]
            to_low, to_high = self.entries[None] - below, self.entries[None] - (below + self.side - 1)
            outside = np.maximum(np.maximum(-to_low, to_high), 0)
            farthest = np.maximum(np.abs(to_low), np.abs(to_high))
            least, most = (outside**2).sum(2), (farthest.astype(np.float64) ** 2).sum(2)
            # the bound is rounded up, so that a tie is never lost to rounding
            kept = least <= (most.min(1) * (1 + 1e-9) + 1)[:, None]
            found += [np.flatnonzero(row) for row in kept]
        return found

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each vector's nearest entry."""
        cells = np.ascontiguousarray(vectors // self.side)
        low, high = cells.min(axis=0), cells.max(axis=0)
        spans = (high - low + 1).tolist()
        if math.prod(spans) < 1 << 62:
            # numbered within this batch's range, which sorts faster than rows
            keys = np.zeros(len(cells), np.int64)
            for column, (least, span) in enumerate(zip(low.tolist(), spans, strict=True)):
                keys = keys * span + (cells[:, column] - least)
        else:
            keys = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        _, first, cell_of = np.unique(keys, return_index=True, return_inverse=True)
        names = [row.tobytes() for row in cells[first]]
        lists = [self.cells.get(name) for name in names]
        new = [i for i, known in enumerate(lists) if known is None]
        if new:
            if len(self.cells) + len(new) > self.most_cells:
                self.cells.clear()
            for i, kept in zip(new, self.candidates(cells[first[new]] * self.side), strict=True):
                lists[i] = self.cells[names[i]] = kept
        sizes = np.array([len(kept) for kept in lists])
        begins = np.cumsum(sizes) - sizes
        count = sizes[cell_of]
        start = np.cumsum(count) - count
        row = np.repeat(np.arange(len(vectors)), count)
        entry = np.concatenate(lists)[np.arange(len(row)) + np.repeat(begins[cell_of] - start, count)]
        distance = np.zeros(len(row), np.int64)
        for column, values in zip(vectors.T, self.entries.T, strict=True):
            # a component at a time: no matrix of all pairs
            apart = np.take(column, row) - np.take(values, entry)
            distance += apart * apart
        least = np.minimum.reduceat(distance, start)
        hits = np.flatnonzero(distance == np.repeat(least, count))
        hits = hits[np.diff(row[hits], prepend=-1) > 0]
        return entry[hits], least


def _search(books: Codebooks, vectors: np.ndarray, cells: list[CellSearch]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and distances, by vector and part."""
    parted = vectors.reshape(len(vectors), books.parts, -1)
    found = [cells[part].nearest(parted[:, part]) for part in range(books.parts)]
    return np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1)


def _limit(size: Column) -> Column:
    """Integers below this in size have squared distances, over ``size`` components, that fit a long."""
    return F.floor(F.lit(float(1 << 30)) / F.sqrt(size))


def integers(df: DataFrame, vector: str, scale: int, parts: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the integers ``floor(scale * x)`` of the usable vectors.

    Not usable: null vectors, vectors with null or non-finite components, those
    that ``parts`` equal parts of one component at least cannot hold, and those
    so large that squared distances would not fit a long.
    """
    size = F.size(F.col(vector))
    double = F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(float(scale)))
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= _limit(size)))
    usable = F.col(vector).isNotNull() & (size > 0) & (size % parts == 0) & ~bad
    return df.where(usable).select(*keep, F.transform(double, lambda x: F.floor(x)).alias("__v"))


def _matrices(batches, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS):
            batch = whole.slice(first, ROWS)
            flat = batch.column("__v").flatten().to_numpy(zero_copy_only=False)
            yield batch, flat.reshape(batch.num_rows, dimension)


def fit(
    df: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all usable vectors (see ``integers``).

    A part's codebook starts as that part of the vectors with the smallest ids,
    ascending; null ids come last, and vectors of one id in their own order. The
    first of them sets the dimension; vectors of others are left out here and by
    ``encode``. A round assigns every part to its nearest entry and replaces
    each used entry by the floored means of its parts. Only sums per entry and
    position come to the driver: ``entries`` times the dimension numbers.
    Without a usable vector there are no entries.
    """
    ship(df.sparkSession)
    usable = integers(df, vector, scale, parts, [F.col(id_column).alias("__id")])
    first = usable.orderBy(F.col("__id").asc_nulls_last(), "__v").limit(1).collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 1), np.int64), scale)
    dimension = len(first[0]["__v"])
    usable = usable.where(F.size("__v") == dimension)
    seeds = usable.orderBy(F.col("__id").asc_nulls_last(), "__v").limit(entries).collect()
    table = np.array([row["__v"] for row in seeds], np.int64).reshape(len(seeds), parts, -1)
    books = Codebooks(np.ascontiguousarray(table.transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        books = _round(usable, books)
    return books


def _round(usable: DataFrame, books: Codebooks) -> Codebooks:
    shape = books.entries.shape

    def partial(batches):
        cells = [CellSearch(entries) for entries in books.entries]
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for _, vectors in _matrices(batches, books.dimension):
            codes, _ = _search(books, vectors, cells)
            parted = vectors.reshape(len(vectors), books.parts, -1)
            for part in range(books.parts):
                order = np.argsort(codes[:, part], kind="stable")
                used, first, count = np.unique(codes[order, part], return_index=True, return_counts=True)
                sums[part, used] += np.add.reduceat(parted[order, part], first, axis=0)
                counts[part, used] += count
        slot = np.flatnonzero(np.repeat(counts.ravel() > 0, shape[2]))
        yield pa.record_batch(
            {"slot": slot, "total": sums.ravel()[slot], "count": np.repeat(counts.ravel(), shape[2])[slot]}
        )

    found = (
        usable.select("__v")
        .mapInArrow(partial, "slot long, total long, count long")
        .groupBy("slot")
        .agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
        .collect()
    )
    entries = books.entries.copy().ravel()
    for row in found:
        entries[row["slot"]] = row["total"] // row["count"]
    return Codebooks(entries.reshape(shape), books.scale)


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Columns ``keep``, ``code`` (binary, one byte a part) and ``error`` of each usable vector.

    ``error`` is the sum of the parts' squared distances to their entries. At
    most 256 entries fit a byte. Repeated rows stay repeated.
    """
    ship(df.sparkSession)
    if books.entries.shape[1] > 256:
        raise ValueError("at most 256 entries fit one byte")
    usable = integers(df, vector, books.scale, books.parts, [F.col(name) for name in keep])
    schema = T.StructType(
        [*usable.drop("__v").schema.fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]
    )

    def coded(batches):
        cells = [CellSearch(entries) for entries in books.entries]
        for batch, vectors in _matrices(batches, books.dimension):
            codes, distances = _search(books, vectors, cells)
            blob = codes.astype(np.uint8)
            columns = [batch.column(name) for name in batch.schema.names if name != "__v"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([row.tobytes() for row in blob], pa.binary()), pa.array(distances.sum(1))],
                names=schema.names,
            )

    wanted = books.dimension if books.entries.shape[1] else -1
    return usable.where(F.size("__v") == wanted).mapInArrow(coded, schema)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``label_error``: the sum of ``error`` over all rows of the same label, null labels together.

    Sums are merged before the shuffle and written as a table of known size. If
    that is small Spark broadcasts it; otherwise it joins by label, and splits a hot label.
    """
    coded = materialise(coded, "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")
    totals = materialise(coded.groupBy(F.col(label).alias("__label")).agg(total), "label-errors")
    return coded.join(totals, coded[label].eqNullSafe(totals["__label"]), "left").drop("__label")
