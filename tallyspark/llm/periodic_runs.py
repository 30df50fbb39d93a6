"""Runs of periodically repeated words, found per octave of the period over overlapping tiles.

A run is a stretch of words with smallest period q, at least four periods long,
that no neighbouring word extends. For the periods from 2**k up to 2**(k+1) a
document has a boundary every 2**k words. A run's first boundary b lies in its
first period, so the words from b on repeat at a distance of q for more than
two further periods: a Z-function of the words from b on gives that for every
q at once, and a second one, of the words before b in reverse, tells how far
the match reaches back.

Documents are exploded into tiles, some boundaries of one octave with the words
around them. A tile is made only where equal hashes of 2**(k+1) words at a
distance of one octave say that a boundary may lie in a run. Tiles are dealt
over the cluster one by one, so a long document is solved by many tasks. Each
gives intervals of positions whose word is repeated q later; intervals are
shuffled by document and period and stitched where they touch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import mix64, ship, slices
from tallyspark.session import materialise

#: Words whose boundaries a tile holds at least; from octave 9 on it holds eight boundaries.
TILE_WORDS = 4_096
TILE_BOUNDARIES = 8
#: Periods a run has at least. Tiles reach as far as this needs; more is a filter, less would not be found.
PERIODS = 4
#: Words before and after a boundary that a tile holds, in units of 2**octave.
BACK, AHEAD = 1, 8


def z_function(s: list[int], size: int | None = None) -> list[int]:
    """For each position above 0, and below ``size``, how many items from there on equal those from the start on."""
    n = len(s)
    size = n if size is None else min(n, size)
    z = [0] * size
    left = right = 0
    for i in range(1, size):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _core(octave: int) -> int:
    return max(TILE_WORDS, TILE_BOUNDARIES << octave)


def _doubled(hashes: np.ndarray, octave: int) -> np.ndarray:
    """Hashes of twice as many words, from those of 2**octave words at each position; none beyond the end equal any."""
    step = 1 << octave
    if len(hashes) <= step:
        return np.arange(len(hashes), dtype=np.uint64)
    joined = mix64(hashes[:-step] * np.uint64(0x9E3779B97F4A7C15) + hashes[step:])
    return np.concatenate([joined, np.arange(len(hashes), len(hashes) + step, dtype=np.uint64)])


def _word_hashes(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(1))


def promising_tiles(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Document, octave, and first and last boundary (word numbers) of every tile in which a run may start.

    ``codes`` holds the documents in a row; a number that is not used anywhere
    else stands behind each of them.
    """
    owner = np.repeat(np.arange(len(starts)), sizes + 1)
    place = np.arange(len(codes)) - starts[owner]
    hashes = _word_hashes(codes)
    octave = 0
    longest = int(sizes.max(initial=0))
    while PERIODS << octave <= longest:
        step = 1 << octave
        hashes = _doubled(hashes, octave)
        later = np.flatnonzero(place >= step)
        boundary = later - (place[later] & (step - 1)) - step
        found = boundary[hashes[boundary] == hashes[later]]
        core = _core(octave)
        tile = owner[found] * (longest // core + 1) + place[found] // core
        begins = np.flatnonzero(np.diff(tile, prepend=-1))
        for first, last in zip(begins.tolist(), [*(begins[1:] - 1).tolist(), len(found) - 1], strict=False):
            yield int(owner[found[first]]), octave, int(place[found[first]]), int(place[found[last]])
        octave += 1


def _candidates(words: np.ndarray, octave: int, first: int, last: int) -> tuple[list[int], list[int]]:
    """Boundaries and periods of an octave for which 2**(octave + 1) words may be repeated one period later."""
    step = 1 << octave
    hashes = _word_hashes(words)
    for lower in range(octave + 1):
        hashes = _doubled(hashes, lower)
    later = np.arange(first + step, min(len(words), last + 2 * step))
    boundary = later - ((later - first) & (step - 1)) - step
    equal = hashes[boundary] == hashes[later]
    return boundary[equal].tolist(), (later - boundary)[equal].tolist()


def solve_tile(words: np.ndarray, low: int, total: int, octave: int, first: int, last: int) -> list[tuple[int, int, int]]:
    """Intervals (period, first, last): words from ``first`` to before ``last`` are repeated one period later.

    ``words`` are numbers of the document's words from ``low`` on, ``total`` its
    word count, ``first`` and ``last`` the tile's outermost boundaries.
    Intervals end where the match does or where the tile does; those that end
    inside and are too short for a run are left out.
    """
    step, text = 1 << octave, words.tolist()
    high = low + len(text)
    open_: dict[int, tuple[int, int]] = {}
    closed = []

    def close(period: int) -> None:
        begin, end = open_.pop(period)
        whole = (begin > 0 or low == 0) and (end + period < len(text) or high == total)
        if not whole or end - begin + period >= PERIODS * period:
            closed.append((period, low + begin, low + end))

    # how far each period's matches are known, and whether the words looked at end there
    known: dict[int, tuple[int, bool]] = {}
    done = -1
    for b, candidate in zip(*_candidates(words, octave, first - low, last - low), strict=True):
        if b == done:
            continue
        end, cut = known.get(candidate, (0, False))
        if b + 2 * candidate <= end or (b < end and not cut):
            continue
        done = b
        ahead = text[b : b + AHEAD * step]
        z = z_function(ahead, 2 * step)
        reach, periods = 0, []
        for period in range(1, len(z)):
            reached = period + z[period]
            if period >= step and z[period] >= 2 * period:
                known[period] = (b + z[period], reached == len(ahead) and b + len(ahead) < len(text))
                # the smallest period of the next two periods must be this one
                if reach < 2 * period:
                    periods.append(period)
            if reached > reach:
                reach = reached
        if not periods:
            continue
        back = min(b, BACK * step)
        after = text[b : b + 2 * step - 1][::-1]
        behind = z_function([*text[b - back : b][::-1], -1, *after])
        for period in periods:
            begin = b - (behind[back + 1 + len(after) - period] if back else 0)
            end, cut = known[period]
            if cut:
                # a run goes on behind the words looked at: follow it to its end in the tile
                differs = words[end + period :] != words[end : len(text) - period]
                end = end + int(differs.argmax()) if differs.any() else len(text) - period
                known[period] = (end, False)
            if period in open_ and begin <= open_[period][1]:
                open_[period] = (open_[period][0], max(end, open_[period][1]))
            else:
                if period in open_:
                    close(period)
                open_[period] = (begin, end)
    for period in list(open_):
        close(period)
    return closed


_FIELDS = [
    T.StructField("__n", T.LongType()),
    T.StructField("__words", T.StringType()),
    T.StructField("__tiled", T.BooleanType()),
    T.StructField("__octave", T.IntegerType()),
    T.StructField("__low", T.LongType()),
    T.StructField("__first", T.LongType()),
    T.StructField("__last", T.LongType()),
    T.StructField("__codes", T.BinaryType()),
]
#: Bytes of tiles in one batch.
BATCH_BYTES = 1 << 22


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with one blank between words, and their words as numbers (see ``promising_tiles``)."""
    # blanks and the bytes 9 to 13; there may be empty words at both ends
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    words = split.flatten().dictionary_encode()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(pc.fill_null(texts, ""))), 0).to_numpy(zero_copy_only=False)
    numbers = words.indices.to_numpy().astype(np.int64)
    # an empty text splits into one empty word
    numbers = numbers[np.repeat(~empty, counts)]
    counts[empty] = 0
    starts = np.cumsum(counts + 1) - counts - 1
    codes = np.empty(len(numbers) + len(counts), np.int64)
    ends = starts + counts
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside] = numbers
    codes[ends] = len(words.dictionary) + np.arange(len(counts))
    return pc.binary_join(split, " "), codes, starts, counts


def _explode(id_field: T.StructField):
    """Rows of tiles, and a row for each document behind its tiles."""
    names = ["__key", id_field.name, *[field.name for field in _FIELDS]]

    def batch_of(source, taken, columns):
        ids = [source.column(name).take(pa.array(taken, pa.int64())) for name in ("__key", id_field.name)]
        return pa.RecordBatch.from_arrays([*ids, *columns], names=names)

    def rows(batches):
        for batch in slices(batches, "__text"):
            joined, codes, starts, sizes = _numbered(batch.column("__text"))
            tiled = np.zeros(len(sizes), bool)
            narrow = np.uint16 if len(codes) and codes.max() < 1 << 16 else np.int32
            taken, found, held = [], [], 0

            def tiles(found=found):
                kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), *[pa.int64()] * 3, pa.binary()]
                return [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]

            for doc, octave, first, last in promising_tiles(codes, starts, sizes):
                low = max(0, first - (BACK << octave))
                high = min(int(sizes[doc]), last + (AHEAD << octave))
                words = codes[starts[doc] + low : starts[doc] + high].astype(narrow).tobytes()
                tiled[doc] = True
                taken.append(doc)
                found.append((int(sizes[doc]), None, True, octave, low, first, last, words))
                held += len(words)
                if held > BATCH_BYTES:
                    yield batch_of(batch, taken, tiles())
                    taken.clear()
                    found.clear()
                    held = 0
            if taken:
                yield batch_of(batch, taken, tiles())
            n = len(sizes)
            none = [pa.nulls(n, kind) for kind in (pa.int32(), *[pa.int64()] * 3, pa.binary())]
            yield batch_of(batch, range(n), [pa.array(sizes), joined, pa.array(tiled), *none])

    return rows, T.StructType([T.StructField("__key", T.LongType()), id_field, *_FIELDS])


def _solve(batches):
    for batch in batches:
        found = []
        for key, total, octave, low, first, last, codes in zip(
            *(column.to_pylist() for column in batch.columns), strict=True
        ):
            size = min(total, last + (AHEAD << octave)) - low
            words = np.frombuffer(codes, np.uint16 if len(codes) == 2 * size else np.int32)
            found += [(key, *interval) for interval in solve_tile(words, low, total, octave, first, last)]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(column), pa.int64()) for column in columns], names=["__key", "period", "first", "last"]
        )


def stitch(intervals: DataFrame) -> DataFrame:
    """Unite intervals of one document and period where they overlap or touch.

    A group has at most one interval per run that a tile holds of that period.
    """
    order = Window.partitionBy("__key", "period").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first") > reached, F.lit(True)).cast("long")
    return (
        intervals.withColumn("__opens", opens)
        .withColumn("__island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("__key", "period", "__island")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("__island")
    )


def _collapse(id_name: str):
    def rows(batches):
        for batch in slices(batches, "__words"):
            kept = []
            for text, runs in zip(batch.column("__words").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                if not runs:
                    kept.append(text)
                    continue
                words = text.split(" ")
                change = np.zeros(len(words) + 1, np.int64)
                for run in runs:
                    change[run["start"] + run["period"]] += 1
                    change[run["start"] + run["length"]] -= 1
                kept.append(" ".join([words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_name), batch.column("n_words"), batch.column("runs"), pa.array(kept, pa.string())],
                names=[id_name, "n_words", "runs", "collapsed"],
            )

    return rows


def periodic_runs(docs: DataFrame, min_length: int = 6, min_periods: int = PERIODS, doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` is an array of (start, length, period), in words and by start, then
    period, of all runs of at least ``min_length`` words and ``min_periods``
    periods (four or more). ``collapsed`` holds the words, joined by one blank, without
    those that a run contains after its first period. Words are what blanks and
    the characters 9 to 13 divide. Null and empty texts have no words and no
    runs. Rows that repeat an id, or have none, are judged one by one.
    """
    if min_periods < PERIODS:
        raise ValueError(f"runs of less than {PERIODS} periods are not found")
    ship(docs.sparkSession)
    named = docs.select(
        F.monotonically_increasing_id().alias("__key"), doc_id, F.col("text").cast("string").alias("__text")
    )
    explode, schema = _explode(docs.schema[doc_id])
    stage = materialise(named.mapInArrow(explode, schema), "runs", "zstd")
    tiles = stage.where(F.col("__octave").isNotNull()).repartition("__key", "__octave", "__low")
    intervals = tiles.select("__key", "__n", "__octave", "__low", "__first", "__last", "__codes").mapInArrow(
        _solve, "__key long, period long, first long, last long"
    )
    length = F.col("last") - F.col("first") + F.col("period")
    long_enough = length >= F.greatest(F.lit(min_length).cast("long"), min_periods * F.col("period"))
    by_start = F.array_sort(F.collect_list(F.struct(F.col("first").alias("start"), "period", length.alias("length"))))
    runs = (
        stitch(intervals)
        .where(long_enough)
        .groupBy("__key")
        .agg(F.transform(by_start, lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs"))
    )
    rows = stage.where(F.col("__octave").isNull()).select("__key", doc_id, F.col("__n").alias("n_words"), "__words", "__tiled")
    none = F.array().cast("array<struct<start:long,length:long,period:long>>")
    tiled = rows.where("__tiled").join(runs, "__key", "left").withColumn("runs", F.coalesce("runs", none))
    output = T.StructType(
        [
            docs.schema[doc_id],
            *T.StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").fields,
        ]
    )
    cut = tiled.select(doc_id, "n_words", "runs", "__words").mapInArrow(_collapse(doc_id), output)
    plain = rows.where("not __tiled").select(doc_id, "n_words", none.alias("runs"), F.col("__words").alias("collapsed"))
    return cut.unionByName(plain)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none if it is null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1), F.array().cast("array<string>"))


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One document in ten, by the hash of its id, with a period from some word on.

    Let h be the crc32 of the decimal id and g = floor(h / 10). If h % 10 is 0,
    word i from a = g % n on becomes word a + (i - a) % p of the n words, where
    p = 1 + floor((n - a) / (3 + g % 8)). Without id or words nothing changes.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def edited(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.when(n > 0, F.pmod(g, n)).otherwise(F.lit(0).cast("long"))
        p = F.floor((n - a) / (3 + g % 8)).cast("long") + 1

        def word(w: Column, i: Column) -> Column:
            return F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))

        return F.array_join(F.transform(words, word), " ")

    # words are bound to a lambda's variable, so that they are found once and not once per word
    changed = F.transform(F.array(words_of(F.col("text"))), edited)[0]
    planted = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").isNotNull()
    return docs.withColumn("text", F.when(planted, changed).otherwise(F.col("text")))
