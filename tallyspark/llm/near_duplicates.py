"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. Each text becomes its set of word shingles. Documents of equal sets are one
   node from then on, so copies never meet each other.
2. Signatures come from two permutations of 32-bit numbers: the first is
   applied to the shingle hashes, the second gives all coordinates, shifted
   circularly by one for each.
3. Coordinates are cut into bands; nodes that share a band are in a bucket.
4. A bucket's members are compared with its least member, its centre, on
   their full shingle sets. Members that end up in another component than the
   bucket's largest are compared with some further members, and those still
   apart with all members of the bucket in other components, except where
   sizes, the distances to the centre (Jaccard distance is a metric) or odd
   sketches rule a link out. An odd sketch keeps the parity of the shingles of
   each of some slots; sets differ in at least as many shingles as their
   sketches in bits. So every pair that shares a band is decided, although
   members of one component are not compared with each other.
5. Links make components; a document's component is its least document id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import mix64, slices
from tallyspark.llm.components import components
from tallyspark.llm.wordhash import forgetting, sequence_hashes, word_hashes
from tallyspark.session import materialise

#: 40 bands of 6: a pair of similarity 0.8 shares no band in 5 of a million cases.
BANDS = 40
ROWS = 6
#: 64-bit words of a set's odd sketch.
ODD = 16
#: Elements handled at a time when signatures are computed.
_BLOCK = 1 << 16
_SHIFTS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint32)[:, None]


def words(text: str | None) -> list[bytes]:
    """Words between white space of ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(split: list[list[bytes]], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document.

    A shorter text is one shingle, its whole sequence; no words give none.
    """
    hashes, counts = word_hashes(split)
    whole = sequence_hashes(hashes, tuple(range(size)))
    sets, first = [], 0
    for count in counts.tolist():
        if count >= size:
            sets.append(np.unique(whole[first : first + count - size + 1]))
        elif count:
            sets.append(sequence_hashes(hashes[first : first + count], tuple(range(count))))
        else:
            sets.append(np.empty(0, np.uint64))
        first += count
    return sets


def signature(found: np.ndarray) -> np.ndarray:
    """All coordinates of a set: minima over the second permutation, shifted by 1, 2, ..."""
    placed = (mix64(found) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    least = np.full(len(_SHIFTS), 0xFFFFFFFF, dtype=np.uint32)
    step = max(1, _BLOCK // len(_SHIFTS))
    for start in range(0, len(placed), step):
        x = placed[None, start : start + step] + _SHIFTS
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per document and band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """For each slot whether it has an odd number of shingles, as signed 64-bit words."""
    slots = (mix64(found ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(64 * ODD)).astype(np.int64)
    odd = (np.bincount(slots, minlength=64 * ODD) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's 128-bit hash, the keys of its bands, its odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingles([words(t) for t in batch.column("text").to_pylist()], size)
            digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
            halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
            keys = band_keys(np.array([signature(s) for s in sets]))
            odd = np.concatenate([odd_sketch(s) for s in sets])
            ends = np.arange(len(sets) + 1, dtype=np.int32)
            columns = [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.ascontiguousarray(halves[:, 0])),
                pa.array(np.ascontiguousarray(halves[:, 1])),
                pa.ListArray.from_arrays(pa.array(ends * BANDS), pa.array(keys.ravel())),
                pa.ListArray.from_arrays(pa.array(ends * ODD), pa.array(odd)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "bands", "odd"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<long>, odd array<long>"
    return docs.select("doc_id", "text").mapInArrow(forgetting(run), schema)


def compare(pairs: DataFrame, node_texts: DataFrame, size: int) -> DataFrame:
    """(u, v, shared, total): exact sizes of intersection and union for pairs of nodes (u, v)."""
    left = node_texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    right = node_texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    rows = pairs.select("u", "v").distinct().join(right, "v").join(left, "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, None
        for batch in slices(slices(batches, "text_v"), "text_u"):
            us, vs = batch.column("u"), batch.column("v")
            sets = shingles([words(t) for t in batch.column("text_v").to_pylist()], size)
            shared, total = [], []
            for i, (u, other) in enumerate(zip(us.to_pylist(), sets, strict=True)):
                if u != at:
                    at, kept = u, shingles([words(batch.column("text_u")[i].as_py())], size)[0]
                same = len(np.intersect1d(kept, other, assume_unique=True))
                shared.append(same)
                total.append(len(kept) + len(other) - same)
            yield pa.RecordBatch.from_arrays(
                [us, vs, pa.array(shared, pa.int64()), pa.array(total, pa.int64())],
                ["u", "v", "shared", "total"],
            )

    return rows.select("u", "v", "text_u", "text_v").mapInArrow(
        forgetting(run), "u long, v long, shared long, total long"
    )


def near_duplicates(docs: DataFrame, size: int = 5, threshold: Fraction | float = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    ``doc_id`` is a 64-bit integer that names a document: rows that repeat it
    are the same document and share their answer. Texts without words (null,
    empty, white space) have 0 shingles and are linked with nothing; so is a
    row with a null id, whose component is null and which is kept. Documents
    are linked when 100 * shared >= 100 * threshold * union, in integers.
    """
    limit = Fraction(threshold).limit_denominator(1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialise(sketches(docs, size), "sketch")
    nodes = materialise(
        sketch.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b")
        .agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("odd").alias("odd"),
        ),
        "nodes",
    )
    member = materialise(_members(nodes), "members")
    texts = materialise(
        docs.join(member.select(F.col("id").alias("doc_id")).distinct(), "doc_id").select(
            F.col("doc_id").alias("id"), "text"
        ),
        "texts",
    )
    # Documents of one id with several texts: any of them may be its node's
    links = materialise(_links(member, nodes, texts, size, limit), "links")
    same = sketch.where("n_shingles > 0 and doc_id is not null").join(
        nodes.select("set_a", "set_b", "id"), ["set_a", "set_b"]
    )
    own = same.select("doc_id", "n_shingles", "id")
    labels = components(links)
    known = own.join(labels, "id", "left").select(
        "doc_id", F.coalesce("label", "id").alias("component_id")
    )
    known = known.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return (
        sketch.select("doc_id", "n_shingles")
        .join(known, "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        )
    )


def _members(nodes: DataFrame) -> DataFrame:
    """(bucket, id, n, centre): nodes that share a band with another node."""
    spread = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    buckets = (
        spread.groupBy("bucket")
        .agg(F.min("id").alias("centre"), F.max("id").alias("most"))
        .where("centre < most")
        .select("bucket", "centre")
    )
    return spread.join(buckets, "bucket")


def _links(member: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, limit: Fraction) -> DataFrame:
    """All links needed for the components of the pairs that share a band."""
    near = F.col("shared") * limit.denominator >= F.col("total") * limit.numerator
    fits = (
        F.least("n", "m") * F.lit(limit.denominator) >= F.greatest("n", "m") * F.lit(limit.numerator)
    )
    stars = member.where("id <> centre").select(F.col("centre").alias("u"), F.col("id").alias("v"))
    compared = materialise(compare(stars, texts, size), "compared")
    links = compared.where(near).select("u", "v")

    # second look: members apart from the largest component of their bucket
    apart = _apart(member, links)
    if apart is None:
        return links
    pivots = (
        apart.where("largest")
        .groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(4)))
        .agg(F.max("id").alias("u"))
        .select("bucket", "u")
    )
    pairs = apart.where(~F.col("largest")).join(pivots, "bucket").select("u", F.col("id").alias("v"))
    second = materialise(compare(pairs.join(_pairs(compared), ["u", "v"], "left_anti"), texts, size), "compared")
    links = links.union(second.where(near).select("u", "v"))

    # the rest: every pair of different components in one bucket that is not ruled out
    apart = _apart(member, links)
    if apart is None:
        return links
    centre = compared.select(
        F.col("u").alias("centre"), F.col("v").alias("id"), (1 - F.col("shared") / F.col("total")).alias("far")
    )
    apart = materialise(
        apart.join(centre, ["centre", "id"], "left")
        .withColumn("far", F.coalesce("far", F.lit(0.0)))
        .join(nodes.select("id", "bands", "odd"), "id"),
        "apart",
    )
    others = apart.select(
        "bucket",
        F.col("id").alias("v"),
        F.col("label").alias("label_v"),
        F.col("n").alias("m"),
        F.col("far").alias("far_v"),
        F.col("largest").alias("largest_v"),
        F.col("bands").alias("bands_v"),
        F.col("odd").alias("odd_v"),
    )
    slack = float(1 - limit) + 1e-9
    # sets of n and m shingles are linked when they differ in (n + m) * (1 - limit) / (1 + limit) at most
    differ = sum(
        (F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("odd_v")[i])) for i in range(ODD)), F.lit(0)
    )
    may = differ * F.lit(limit.denominator + limit.numerator) <= (F.col("n") + F.col("m")) * F.lit(
        limit.denominator - limit.numerator
    )
    # a pair counts in the first of its buckets alone
    first = F.array_min(F.array_intersect("bands", "bands_v")) == F.col("bucket")
    rest = (
        apart.where(~F.col("largest"))
        .join(others, "bucket")
        .where(
            (F.col("label") != F.col("label_v"))
            & (F.col("largest_v") | (F.col("id") < F.col("v")))
            & fits
            & (F.abs(F.col("far") - F.col("far_v")) <= slack)
            & may
            & first
        )
        .select(F.least("id", "v").alias("u"), F.greatest("id", "v").alias("v"))
    )
    for done in (compared, second):
        rest = rest.join(_pairs(done), ["u", "v"], "left_anti")
    third = compare(rest, texts, size)
    return links.union(third.where(near).select("u", "v"))


def _pairs(compared: DataFrame) -> DataFrame:
    """Compared pairs in both directions."""
    return compared.select("u", "v").union(compared.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _apart(member: DataFrame, links: DataFrame) -> DataFrame | None:
    """Members of buckets that hold several components, marked where theirs is the largest there."""
    labelled = member.join(components(links), "id", "left").withColumn("label", F.coalesce("label", "id"))
    labelled = materialise(labelled, "labelled")
    counts = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    buckets = (
        counts.groupBy("bucket")
        .agg(
            F.max(F.struct("c", "label"))["label"].alias("main"),
            F.count(F.lit(1)).alias("labels"),
            F.sum("c").alias("size"),
        )
        # two members were compared with each other already
        .where("labels > 1 and size > 2")
        .select("bucket", "main")
    )
    found = materialise(
        labelled.join(buckets, "bucket").withColumn("largest", F.col("label") == F.col("main")).drop("main"),
        "apart",
    )
    return None if found.isEmpty() else found


def drop_near_duplicates(
    docs: DataFrame, size: int = 5, threshold: Fraction | float = Fraction(4, 5)
) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the one of least id.

    Every row is judged by its own text: rows that repeat an id and rows with
    a null id belong to groups like any others, a null id comes last, and
    equal rows leave one. Rows are told apart by a 64-bit hash of id and text.
    Texts without words are in no group, so all of them stay.
    """
    names, key = docs.columns, "near_row"
    while key in names:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    judged = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), size, threshold)
    groups = materialise(
        judged.where("n_shingles > 0")
        .groupBy(F.col("doc_id").alias(key))
        .agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("copies")),
        "groups",
    )
    by_id = keyed.select(key, F.col("doc_id").cast("long").alias("doc_id")).distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", key))
    kept = groups.join(by_id, key).groupBy("component_id").agg(least[key].alias(key)).select(key)
    kept = materialise(groups.join(kept, key).select(key, "copies"), "kept")
    rest = keyed.join(groups.select(key).join(kept, key, "left_anti"), key, "left_anti")
    copied = kept.where("copies > 1").select(key)
    one = (
        rest.join(copied, key, "left_semi")
        .groupBy(key)
        .agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("one"))
        .select("one.*")
    )
    return rest.join(copied, key, "left_anti").select(*names).union(one)
