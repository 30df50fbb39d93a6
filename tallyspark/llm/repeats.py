"""Removal of byte strings that repeat anywhere in a corpus, by distributed suffix sorting.

A string of ``length`` bytes is removed wherever it starts more than once.
Sorting every suffix of the corpus would move many times its size, so the
cover of sampled suffixes is chosen by content instead of by position: a
position is sampled when the hash of its first bytes is the least of some
window. As with a difference cover, equal strings have a sampled position at
the same distance from their starts.

1. Sampled positions are named by their first bytes; each also carries a name
   of its surroundings, the bytes that strings through it can reach. Names
   that occur once end here: no string through them repeats.
2. Positions with equal surroundings are settled: all strings through them
   repeat. One of them stands for all in what follows.
3. The surroundings that differ are split by name over the tasks. A task parts
   them by the bytes that strings of near starts have in common; what no other
   excerpt shares ends here, and what is one text at several places is settled.
   The rest is sorted by suffix: sampled triples, recursion on their names,
   merge of the remaining suffixes (``suffixes.py``). Neighbours with equal
   prefixes of ``length`` bytes are repeats.
4. Names of more than ``GROUP`` positions, counted exactly, never meet in a
   task: every string through their positions is hashed, and Spark keeps the
   least and the greatest place of each hash, partially aggregated.

A name that a large part of the corpus shares is found on a sample first, only
to count its positions by parts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import mix64, slices
from tallyspark.llm.suffixes import repeated_starts
from tallyspark.session import materialise

LENGTH = 200
#: A name is hot when one in so many sampled positions of a part of the corpus has it.
HOT_SHARE = 500
#: The part that is looked at for hot names: one in so many documents.
HOT_PART = 32
#: Or, in a large corpus, when the part lets expect so many positions of it.
HOT_COUNT = 20_000
#: Parts of a hot name's positions.
SALTS = 32
#: Positions that a name has at most when its surroundings are compared in one task.
GROUP = 2000
#: Start distances that share a part of surroundings within a task.
FINE_STEP = 14
#: Bytes of surroundings that a task sorts at a time, in whole names.
SORT_BYTES = 2_000_000
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Powers:
    """Powers of the hash's base and of its inverse, as far as a worker needed them."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        while len(cls.up) < n:
            size = len(cls.up)
            up, down = pow(_BASE, size, 1 << 64), pow(_INVERSE, size, 1 << 64)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(up)])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(down)])


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - width + size], x[width - size :]) if size < width else x


def sampled(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Sampled positions of several documents in one buffer, each at least ``length`` bytes long.

    Returns position, document, name, name of the surroundings.
    """
    k = length // 3
    width = length - k + 1
    n = len(data)
    _Powers.reach(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _Powers.up[:n], out=prefix[1:])
    keys = mix64((prefix[k:] - prefix[:-k]) * _Powers.down[: n - k + 1])
    first = np.concatenate([[0], ends[:-1]])
    for end in ends[:-1].tolist():
        keys[end - k + 1 : end] = _NONE
    least = _sliding(keys, width, np.minimum)
    for end in ends[:-1].tolist():
        least[end - length + 1 : end] = 0
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    position = np.flatnonzero((keys == _sliding(padded, width, np.maximum)) & (keys != _NONE))
    document = np.searchsorted(ends, position, side="right")
    left = np.maximum(position - (width - 1), first[document])
    right = np.minimum(position + length, ends[document])
    around = (prefix[right] - prefix[left]) * _Powers.down[left]
    around = mix64(around ^ mix64(((position - left) << 32 | (right - position)).astype(np.uint64)))
    return position - first[document], document, keys[position], around


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(row, at, name, around) of all sampled positions; ``docs`` has ``row`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            found = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            long = [i for i, t in enumerate(found) if len(t) >= length]
            if not long:
                continue
            data = np.frombuffer(b"".join(found[i] for i in long), np.uint8)
            ends = np.cumsum([len(found[i]) for i in long])
            at, document, name, around = sampled(data, ends, length)
            rows = batch.column("row").to_numpy()[long][document]
            columns = [pa.array(rows), pa.array(at), pa.array(name.view(np.int64)), pa.array(around.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "at", "name", "around"])

    return docs.select("row", "text").mapInArrow(run, "row long, at long, name long, around long")


def _hot_names(docs: DataFrame, length: int) -> DataFrame:
    """Names that one in ``HOT_SHARE`` sampled positions has, or ``HOT_COUNT`` in all: few beside the positions."""
    part = docs.where(F.pmod(F.xxhash64("row"), F.lit(HOT_PART)) == 0)
    counts = materialise(anchors(part, length).groupBy("name").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = (F.col("n") * HOT_SHARE > total) | (F.col("n") * HOT_PART > HOT_COUNT)
    return materialise(counts.where((F.col("n") > 8) & many).select("name"), "hot")


def _repeated(docs: DataFrame, length: int, hot: DataFrame) -> DataFrame:
    """Sampled positions whose name occurs again: (row, at, name, large, settled, open).

    ``large`` marks names of more than ``GROUP`` positions, ``open`` positions whose name has other surroundings, too; of those
    with equal surroundings, one (of a hot name, one in each part).
    """
    marked = anchors(docs, length).join(
        F.broadcast(hot.withColumn("hot", F.lit(True))), "name", "left"
    ).withColumn("hot", F.coalesce("hot", F.lit(False)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("row", "at"), F.lit(SALTS))).otherwise(0)
    placed = Window.partitionBy("name", "salt").orderBy("around")
    group = placed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    like_last = F.coalesce(F.lag("around").over(placed) == F.col("around"), F.lit(False))
    like_next = F.coalesce(F.lead("around").over(placed) == F.col("around"), F.lit(False))
    seen = materialise(
        marked.withColumn("salt", salt)
        .select(
            "row",
            "at",
            "name",
            "hot",
            F.count(F.lit(1)).over(group).alias("n"),
            F.min("around").over(group).alias("low"),
            F.max("around").over(group).alias("high"),
            (like_last | like_next).alias("twin"),
            (~like_last).alias("first"),
        )
        .where("hot or n > 1"),
        "repeated",
    )
    parts = (
        seen.where("hot")
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("all"), F.min("low").alias("lowest"), F.max("high").alias("highest"))
    )
    joined = seen.join(F.broadcast(parts), "name", "left")
    return joined.where("all is null or all > 1").select(
        "row",
        "at",
        "name",
        (F.coalesce("all", "n") > GROUP).alias("large"),
        (F.col("twin") | (F.coalesce("lowest", "low") == F.coalesce("highest", "high"))).alias("settled"),
        (F.col("first") & (F.coalesce("lowest", "low") != F.coalesce("highest", "high"))).alias("open"),
    )


def _parts(data: bytes, at: int, length: int, step: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(near, begin, end, core) of the parts of an excerpt whose sampled position is ``at``.

    A part holds the strings that start less than ``step`` places from one place
    backwards; all of them hold its core.
    """
    step = min(step, length // 4)
    for near in range(0, length - length // 3 + 1, step):
        last = at - near
        begin, end = max(0, last - step + 1), min(len(data), last + length)
        if last >= 0 and end - begin >= length:
            yield near, begin, end, data[last : last - step + 1 + length]


def _around(docs: DataFrame, open_positions: DataFrame) -> DataFrame:
    """(row, text, found): texts with all their open positions."""
    found = F.collect_set(F.struct("at", "name", "large")).alias("found")
    return docs.select("row", "text").join(open_positions.groupBy("row").agg(found), "row")


def _surroundings(around: DataFrame, length: int) -> DataFrame:
    """(key, row, first, at, bytes): excerpts of names that are not large; key is the name.

    ``at`` is where in the excerpt its sampled position is.
    """
    width = length - length // 3 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            rows: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("row", "text", "found"))
            for row, text, found in zip(*columns, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in found:
                    if not x["large"]:
                        at = x["at"]
                        low = max(0, at - width + 1)
                        rows.append((x["name"], row, low, at - low, data[low : at + length]))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "row", "first", "at", "bytes"])

    return around.where(F.exists("found", lambda x: ~x["large"])).mapInArrow(
        run, "key long, row long, first long, at long, bytes binary"
    )


def _strings(around: DataFrame, length: int) -> DataFrame:
    """(name, string, row, first): the strings through open positions of large names, by hash."""
    width = length - length // 3 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            columns = (batch.column(c).to_pylist() for c in ("row", "text", "found"))
            for row, text, found in zip(*columns, strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                _Powers.reach(len(data) + 1)
                prefix = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(_BYTE[data] * _Powers.up[: len(data)], out=prefix[1:])
                large = [(x["at"], x["name"]) for x in found if x["large"]]
                for start in range(0, len(large), 512):
                    at, name = (np.array(c, np.int64) for c in zip(*large[start : start + 512], strict=True))
                    first = at[:, None] - np.arange(width)
                    holds = (first >= 0) & (first + length <= len(data))
                    names = np.broadcast_to(name[:, None], first.shape)[holds]
                    first = first[holds]
                    string = mix64((prefix[first + length] - prefix[first]) * _Powers.down[first])
                    arrays = [names, string.view(np.int64), np.full(len(first), row), first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in arrays], ["name", "string", "row", "first"]
                    )

    return around.where(F.exists("found", lambda x: x["large"])).mapInArrow(
        run, "name long, string long, row long, first long"
    )


def _counted_repeats(around: DataFrame, length: int) -> DataFrame:
    """(row, first, end): strings of large names that start at several places."""
    strings = _strings(around, length)
    place = F.struct("row", "first")
    several = (
        strings.groupBy("name", "string")
        .agg(F.min(place).alias("least"), F.max(place).alias("most"))
        .where("least <> most")
        .select("name", "string")
    )
    return strings.join(several, ["name", "string"], "left_semi").select(
        "row", "first", (F.col("first") + length).alias("end")
    )


def _sorted_repeats(excerpts: DataFrame, length: int) -> DataFrame:
    """(row, first, end): runs of bytes of the excerpts that lie in repeated strings."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Excerpts of whole keys, about SORT_BYTES at a time."""
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "row", "first", "at", "bytes"))
            for key, row, first, at, data in zip(*columns, strict=True):
                if key != last and size >= SORT_BYTES:
                    yield held
                    held, size = [], 0
                last = key
                held.append((key, row, first, at, data))
                size += len(data)
        if held:
            yield held

    def shared(held: list[tuple]) -> Iterable[dict[bytes, set[tuple[int, int]]]]:
        """Parts with the same name, nearness and common bytes, where there are several: their texts, and the places of each."""
        alone: dict[tuple, tuple] = {}
        several: dict[tuple, dict[bytes, set[tuple[int, int]]]] = {}
        for key, row, first, at, data in held:
            for near, begin, end, core in _parts(data, at, length, FINE_STEP):
                part, text, place = (key, near, core), data[begin:end], (row, first + begin)
                before = alone.get(part)
                if before is None:
                    alone[part] = (text, place)
                    continue
                found = several.get(part)
                if found is None:
                    found = several[part] = {before[0]: {before[1]}}
                found.setdefault(text, set()).add(place)
        return several.values()

    def whole(parts: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        """(row, first, text): parts of one row whose strings start side by side, as one text."""
        parts.sort(key=lambda part: part[:2])
        row, first, pieces, end = None, 0, [], 0
        for other, begin, text in parts:
            if other == row and begin <= end - length + 1:
                if begin + len(text) > end:
                    pieces.append(text[end - begin :])
                    end = begin + len(text)
                continue
            if row is not None:
                yield row, first, b"".join(pieces)
            row, first, pieces, end = other, begin, [text], begin + len(text)
        if row is not None:
            yield row, first, b"".join(pieces)

    def repeats(held: list[tuple]) -> Iterator[tuple[int, int, int]]:
        # texts at several places are settled, and sorted once for the others' sake
        settled: dict[bytes, set[tuple[int, int]]] = {}
        parts: list[tuple[int, int, bytes]] = []
        for found in shared(held):
            for text, places in found.items():
                if len(places) > 1:
                    yield from ((row, first, first + len(text)) for row, first in places)
                    if len(found) > 1:
                        settled.setdefault(text, set()).update(places)
                elif len(found) > 1:
                    parts += [(row, first, text) for row, first in places]
        open_ = list(whole(parts))
        number: dict[int, int] = {}

        def placed(row: int, first: int) -> int:
            return number.setdefault(row, len(number)) << 40 | first

        spots = [[placed(row, first)] for row, first, _ in open_]
        spots += [[placed(row, first) for row, first in places] for places in settled.values()]
        low, high = (np.array([of(p) for p in spots], dtype=np.int64) for of in (min, max))
        starts_of = repeated_starts([text for _, _, text in open_] + list(settled), low, high, length)
        for (row, first, _), starts in zip(open_, starts_of, strict=False):
            if len(starts):
                breaks = np.flatnonzero(np.diff(starts) > length)
                begin = starts[np.concatenate([[0], breaks + 1])].tolist()
                end = (starts[np.concatenate([breaks, [-1]])] + length).tolist()
                yield from ((row, first + b, first + e) for b, e in zip(begin, end, strict=True))

    def united(spans: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of one row that overlap or touch, as one."""
        out: list[tuple[int, int, int]] = []
        last_row, last_first, last_end = None, 0, 0
        for row, first, end in sorted(set(spans)):
            if row == last_row and first <= last_end:
                last_end = max(last_end, end)
                continue
            if last_row is not None:
                out.append((last_row, last_first, last_end))
            last_row, last_first, last_end = row, first, end
        if last_row is not None:
            out.append((last_row, last_first, last_end))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            rows = united(repeats(held))
            for start in range(0, len(rows), 65536):
                columns = zip(*rows[start : start + 65536], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "first", "end"])

    dealt = excerpts.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "row long, first long, end long")


def _runs(docs: DataFrame, key: str, length: int) -> DataFrame:
    """``docs`` with column ``key`` + "_spans": (first, end) of repeated strings, in any order, null for none."""
    if length < 24:
        raise ValueError("strings of fewer than 24 bytes are too short to sample")
    width = length - length // 3 + 1
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    plain = keyed.select(F.col(key).alias("row"), "text").where(F.octet_length("text") >= length)
    positions = materialise(_repeated(plain, length, _hot_names(plain, length)), "positions")
    # a repeated row has every position twice
    settled = (
        positions.groupBy("row", "at")
        .agg(F.max("settled").alias("settled"), F.count(F.lit(1)).alias("n"))
        .where("settled or n > 1")
        .select(
            "row",
            F.greatest(F.col("at") - width + 1, F.lit(0)).alias("first"),
            (F.col("at") + length).alias("end"),
        )
    )
    around = _around(plain, positions.where("open"))
    spans = settled.union(_sorted_repeats(_surroundings(around, length), length))
    if not positions.where("large and open").isEmpty():
        spans = spans.union(_counted_repeats(around, length))
    runs = materialise(
        spans.groupBy("row").agg(F.collect_set(F.struct("first", "end")).alias("spans")), "spans"
    )
    return keyed.join(
        runs.select(F.col("row").alias(key), F.col("spans").alias(f"{key}_spans")), key, "left"
    )


def _unused(docs: DataFrame) -> str:
    name = "repeat_row"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    return name


def _cut(batch: pa.RecordBatch, spans: str) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """The maximal removed runs and the kept bytes of each text."""
    for text, found in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist(), strict=True):
        data = (text or "").encode("utf-8", "surrogatepass")
        merged: list[list[int]] = []
        for first, end in sorted((x["first"], min(x["end"], len(data))) for x in found or ()):
            if merged and first <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([first, end])
        edges = [0, *(e for run in merged for e in run), len(data)]
        kept = [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
        yield [(a, b) for a, b in merged], b"".join(kept)


def mark_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``removed``, the (first, end) byte runs of its texts that lie in repeated
    strings, and ``kept``, the other bytes.

    Runs are maximal and in order. Strings are judged on the input; they never
    cross documents, and a repeat may overlap itself. Null texts count as
    empty, texts below ``length`` bytes hold no string. A repeated row counts
    as another document, so all of a repeated text of ``length`` bytes is
    marked. Columns of ``docs`` are returned; ones called ``removed`` or
    ``kept`` are replaced.
    """
    docs = docs.drop("removed", "kept")
    names, key = docs.columns, _unused(docs)
    arrow = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])
    added = [T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = list(_cut(batch, f"{key}_spans"))
            removed = pa.array([[{"first": a, "end": b} for a, b in runs] for runs, _ in found], arrow)
            kept = pa.array([k for _, k in found], pa.binary())
            columns = [*(batch.column(c) for c in names), removed, kept]
            yield pa.RecordBatch.from_arrays(columns, [*names, "removed", "kept"])

    return _runs(docs, key, length).mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents without the bytes of repeated strings, with the columns they came with.

    What a cut leaves of a character is dropped. ``n_chars``, where there is
    such a column, is counted anew for changed texts. No document is dropped.
    """
    names, key = docs.columns, _unused(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = list(_cut(batch, f"{key}_spans"))
            texts = [
                kept.decode("utf-8", "ignore") if runs else text
                for (runs, kept), text in zip(found, batch.column("text").to_pylist(), strict=True)
            ]
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                counts = [
                    len(text) if runs else old
                    for (runs, _), text, old in zip(
                        found, texts, columns["n_chars"].to_pylist(), strict=True
                    )
                ]
                columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return _runs(docs, key, length).mapInArrow(run, docs.schema)
