"""Document fingerprints: bottom-k sketches of shingle hashes, in column expressions only.

A shingle is five neighbouring words, words being runs between white space in
lower case; a shorter text is one shingle. A fingerprint is the ``k`` least
distinct hashes of a text's shingles, ascending, as hex of 16 digits each.
Fingerprints of parts merge into that of the whole, and estimate resemblance,
containment and the number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
K = 128
#: Documents of one group when neighbours are looked up.
GROUP = 250
MOST_GROUPS = 100_000
#: Quantiles at which ids are cut.
CUTS = 50


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column, size: int = WORDS) -> Column:
    """Hashes of the shingles, with repeats; a text without words has none."""
    split = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def shingles(hashed: Column) -> Column:
        count = F.greatest(F.size(hashed) - F.lit(size - 1), F.least(F.size(hashed), F.lit(1)))
        at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.slice(hashed, i, F.lit(size))))

    return _once(F.transform(split, lambda w: F.xxhash64(w)), shingles)


def bottom(hashes: Column, k: int = K) -> Column:
    """The ``k`` least distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the part of the union's sketch that both have.

    1 for two empty sketches, 0 for one.
    """
    both = F.array_intersect(a, b)

    def shared(union: Column) -> Column:
        found = F.size(F.array_intersect(union, both)) / F.size(union)
        return F.when(F.size(union) == 0, 1.0).otherwise(found)

    return _once(merge(a, b, k), shared)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    # place of the k-th hash in the range of 64-bit integers
    place = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of the shingles of ``a`` that ``b`` has, too; null for an empty ``a``."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, group, order: the text of the next document in descending doc_id order.

    After the last comes the first; a lone document is its own next. Null
    texts count as empty, null ids as less than all others. Rows that share an
    id follow each other in the order of their texts.

    Documents are sorted in groups of neighbouring ids, about ``GROUP`` each:
    ids are cut at quantiles and evenly between them. The first row of each
    group is also sent to the group above, where it comes last; that takes a
    table of one row per group, at most ``MOST_GROUPS``.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), order.alias("order"))
    found = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("order", [i / CUTS for i in range(CUTS + 1)], 10_000).alias("cuts"),
    ).first()
    cuts = sorted(set(found["cuts"] or [0]))
    fine = max(1, min(MOST_GROUPS, -(-found["n"] // GROUP)) // CUTS)
    below = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("order")))
    low = F.get(F.lit(cuts), F.col("below") - 1).cast("double")
    high = F.get(F.lit(cuts), F.col("below")).cast("double")
    part = F.coalesce(F.floor((F.col("order").cast("double") - low) / (high - low) * fine), F.lit(0))
    rows = rows.withColumn("below", below).select(
        "doc_id", "text", "order", (F.col("below") * (fine + 1) + part).alias("group")
    )
    heads = rows.groupBy("group").agg(F.max("order").alias("order"))
    downwards = Window.orderBy(F.desc("group"))
    everywhere = downwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "order", F.coalesce(F.lag("group").over(downwards), F.min("group").over(everywhere)).alias("above")
    )
    again = rows.join(F.broadcast(heads), "order").select("doc_id", "text", "order", F.col("above").alias("group"))
    both = rows.withColumn("again", F.lit(False)).union(again.withColumn("again", F.lit(True)))
    return both.withColumn("next_text", F.lead("text").over(_within()))


def _within() -> Window:
    return Window.partitionBy("group").orderBy("again", F.desc("order"), "text")


def fingerprints_of_edits(docs: DataFrame, size: int = WORDS, k: int = K) -> DataFrame:
    """Every text, its edited text and their sketches.

    The edited text has its last third replaced by as many first characters
    of the next document. Columns: doc_id, n_chars, edited, sketch,
    edited_sketch, next_sketch. See ``with_next`` for nulls, ties and repeated
    rows; an empty table gives no rows.
    """
    rows = with_next(docs).withColumn("sketch", bottom(shingle_hashes(F.col("text"), size), k))
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(_within())).where(~F.col("again"))
    length = F.char_length("text")
    third = F.floor(length / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), length - third), F.substring("next_text", F.lit(1), third)
    )
    return rows.select(
        "doc_id", length.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch"
    ).withColumn("edited_sketch", bottom(shingle_hashes(F.col("edited"), size), k))
