"""Ranking and running totals that no single task has to hold.

``Window.orderBy`` without a partition sends every row to one task, and
``Window.partitionBy(key)`` sends a hot key to one task. The functions here
spread the rows by range instead, so a key that holds a third of the data is
split over many tasks, and fetch the rest from small per-range counts.

An order is a list of ``(column name, "asc" | "desc")``. NULL sorts first
ascending and last descending. Give enough columns to make the order unique;
rows equal in all of them are numbered in an arbitrary but stable way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import materialise

Order = Sequence[tuple[str, str]]

_ROW_BITS = 33  # monotonically_increasing_id: task index above, row index below
_POS, _PART, _BEFORE = "__pos", "__part", "__before"


def sort_columns(order: Order) -> list[Column]:
    return [
        F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_first()
        for name, way in order
    ]


def ascending(names: Sequence[str]) -> list[tuple[str, str]]:
    return [(name, "asc") for name in names]


def same_keys(names: Sequence[str]) -> Column:
    """``name`` equals ``__name`` for all names, NULL matching NULL."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(f"__{name}"))
    return condition


def _prefixed(df: DataFrame, names: Sequence[str], *rest: str) -> DataFrame:
    return df.select(*[F.col(name).alias(f"__{name}") for name in names], *rest)


def global_positions(
    df: DataFrame,
    order: Order,
    *,
    row: str | None = None,
    rows: str | None = None,
    running: dict[str, str] | None = None,
) -> DataFrame:
    """Row number, row count and running sums over the whole frame.

    One range shuffle; the result is written to the shared folder because range
    bounds are sampled and must not move between counting and numbering.
    The joined offsets hold one row per shuffle partition. Running sums are
    windowed per range, which takes one more shuffle of the same rows.
    """
    running = running or {}
    columns = sort_columns(order)
    placed = materialise(
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn(_POS, F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col(_POS), _ROW_BITS)
    counts = placed.groupBy(part.alias(_PART)).agg(
        F.count("*").alias("__rows"),
        *[F.sum(value).alias(f"__sum_{name}") for value, name in running.items()],
    )
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        _PART,
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias(_BEFORE),
        F.sum("__rows").over(Window.partitionBy()).alias("__total"),
        *[F.sum(f"__sum_{name}").over(earlier).alias(f"__pre_{name}") for name in running.values()],
    )
    if running:
        within = Window.partitionBy(part).orderBy(_POS)
        within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = placed.select(
            "*", *[F.sum(value).over(within).alias(f"__in_{name}") for value, name in running.items()]
        )
    local = F.col(_POS).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(offsets), part == F.col(_PART)).select(
        *df.columns,
        *([(F.col(_BEFORE) + local + 1).alias(row)] if row else []),
        *([F.col("__total").alias(rows)] if rows else []),
        *[carried(f"__in_{name}", f"__pre_{name}").alias(name) for name in running.values()],
    )


def carried(inner: str, outer: str) -> Column:
    """A running total plus what came before; NULL only while nothing was added."""
    return F.when(F.col(inner).isNull(), F.col(outer)).otherwise(
        F.col(inner) + F.coalesce(F.col(outer), F.lit(0))
    )


def global_row_number(
    df: DataFrame, order: Order, name: str = "row_number", total: str | None = None
) -> DataFrame:
    """ROW_NUMBER over the whole frame (1-based), and the row count on request."""
    return global_positions(df, order, row=name, rows=total)


def tile(row_number: Column, rows: Column, tiles: int) -> Column:
    """NTILE from a row number: the first ``rows mod tiles`` tiles are one longer."""
    short = F.floor(rows / F.lit(tiles))
    longer = rows % F.lit(tiles)
    in_long = row_number <= longer * (short + 1)
    return (
        F.when(in_long, F.floor((row_number - 1) / (short + 1)) + 1)
        .otherwise(longer + F.floor((row_number - longer * (short + 1) - 1) / F.nullif(short, F.lit(0))) + 1)
        .cast("bigint")
    )


def global_ntile(df: DataFrame, order: Order, tiles: int, name: str) -> DataFrame:
    numbered = global_row_number(df, order, "__rn", "__n")
    return numbered.withColumn(name, tile(F.col("__rn"), F.col("__n"), tiles)).drop("__rn", "__n")


def keyed_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    name: str = "row_number",
    rows: str | None = None,
) -> DataFrame:
    """ROW_NUMBER per key, and the rows of the key on request."""
    numbered = global_row_number(df, [*ascending(keys), *order], "__g")
    starts = _prefixed(
        numbered.groupBy(*keys).agg(F.min("__g").alias("__lo"), F.count("*").alias("__n")),
        keys,
        "__lo",
        "__n",
    )
    joined = numbered.join(starts, same_keys(keys))
    out = joined.withColumn(name, F.col("__g") - F.col("__lo") + 1)
    if rows is not None:
        out = out.withColumn(rows, F.col("__n"))
    return out.select(*df.columns, name, *([rows] if rows else []))


def keyed_ntile(df: DataFrame, keys: Sequence[str], order: Order, tiles: int, name: str) -> DataFrame:
    numbered = keyed_row_number(df, keys, order, "__rn", "__rows")
    return numbered.withColumn(name, tile(F.col("__rn"), F.col("__rows"), tiles)).drop("__rn", "__rows")


def value_ranks(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """One row per distinct (keys, order values): rank, dense_rank, percent_rank, cume_dist.

    Equal values collapse in the map-side part of the aggregate, so a value
    shared by a third of the rows costs no more than any other.
    """
    values = [name for name, _ in order]
    grouped = df.groupBy(*keys, *values).agg(F.count("*").alias("__c"))
    placed = global_positions(
        grouped, [*ascending(keys), *order], row="__d", running={"__c": "__hi"}
    ).withColumn("__lo", F.col("__hi") - F.col("__c") + 1)
    spans = _prefixed(
        placed.groupBy(*keys).agg(
            F.min("__lo").alias("__start"),
            F.min("__d").alias("__first"),
            F.sum("__c").alias("__n"),
        ),
        keys,
        "__start",
        "__first",
        "__n",
    )
    # without keys there is one span, a single row
    stats = placed.join(spans if keys else F.broadcast(spans), same_keys(keys))
    rank = F.col("__lo") - F.col("__start") + 1
    return stats.select(
        *keys,
        *values,
        rank.alias("rank"),
        (F.col("__d") - F.col("__first") + 1).alias("dense_rank"),
        F.when(F.col("__n") > 1, (rank - 1) / (F.col("__n") - 1))
        .otherwise(F.lit(0.0))
        .alias("percent_rank"),
        ((F.col("__hi") - F.col("__start") + 1) / F.col("__n")).alias("cume_dist"),
    )


def with_ranks(df: DataFrame, keys: Sequence[str], order: Order, names: dict[str, str]) -> DataFrame:
    """Rows with their rank columns; ``names`` maps the function to the new column."""
    values = [name for name, _ in order]
    on = [*keys, *values]
    ranks = value_ranks(df, keys, order)
    ranks = ranks.select(
        *[F.col(name).alias(f"__{name}") for name in on],
        *[F.col(function).alias(alias) for function, alias in names.items()],
    )
    return df.join(ranks, same_keys(on)).select(*df.columns, *names.values())


def with_neighbours(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, lag: str | None, lead: str | None
) -> DataFrame:
    """LAG and LEAD (one row) of ``value`` per key, within sorted ranges.

    Rows are sorted by range and written once; a window per range finds the
    neighbours inside it, and the border rows, one at each end of a range, are
    carried over to the next. A busy key spans many ranges.
    """
    columns = sort_columns([*ascending(keys), *order])
    placed = materialise(
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn(_POS, F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright(F.col(_POS), _ROW_BITS))
    )
    me = F.struct(*[F.col(key).alias(f"k{i}") for i, key in enumerate(keys)], F.col(value).alias("value"))
    ends = placed.groupBy(_PART).agg(
        F.min_by(me, _POS).alias("__first"), F.max_by(me, _POS).alias("__last")
    )
    by_part = Window.orderBy(_PART)  # one row per range
    borders = ends.select(
        F.col(_PART).alias("__at"),
        F.lag("__last").over(by_part).alias("__before"),
        F.lead("__first").over(by_part).alias("__after"),
    )
    within = Window.partitionBy(_PART).orderBy(_POS)
    found = {}
    for name, inside, border in (
        (lag, F.lag(me), "__before"),
        (lead, F.lead(me), "__after"),
    ):
        if name is not None:
            found[name] = F.coalesce(inside.over(within), F.col(border))
    beside = placed.join(F.broadcast(borders), F.col(_PART) == F.col("__at")).select(
        *df.columns, *[other.alias(f"__{name}") for name, other in found.items()]
    )
    out = []
    for name in found:
        same = F.col(f"__{name}").isNotNull()
        for i, key in enumerate(keys):
            same = same & F.col(f"__{name}.k{i}").eqNullSafe(F.col(key))
        out.append(F.when(same, F.col(f"__{name}.value")).alias(name))
    return beside.select(*df.columns, *out)


def neighbours_by_bucket(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    value: str,
    lag: str | None = None,
    lead: str | None = None,
) -> DataFrame:
    """LAG and LEAD (one row) of ``value`` per key, a bucket of the order at a time.

    ``order`` is ascending, and ``bucket`` (the day of a time, say) never falls
    along it. The border rows of a key's buckets, found by an aggregate with
    one row per (keys, bucket), are put in front of and behind each bucket's
    rows, so one window per (keys, bucket) serves: one shuffle of the rows, and
    a busy key is spread over its buckets.
    """
    parts = [*keys, "__bucket"]
    rows = df.withColumns({"__bucket": bucket, "__me": F.struct(F.col(value).alias("value"))})
    place = F.struct(*order)
    ends = rows.groupBy(*parts).agg(
        F.min_by("__me", place).alias("__first"), F.max_by("__me", place).alias("__last")
    )
    by_bucket = Window.partitionBy(*keys).orderBy(F.col("__bucket").asc_nulls_first())
    borders = ends.select(
        *parts, F.lag("__last").over(by_bucket).alias("__before"), F.lead("__first").over(by_bucket).alias("__after")
    )
    sides = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("__before").alias("me")),
        F.struct(F.lit(2).alias("kind"), F.col("__after").alias("me")),
    )
    beside = borders.select(*parts, F.explode(sides).alias("b")).select(
        *parts, F.col("b.kind").alias("__kind"), F.col("b.me").alias("__me")
    )
    carried = rows.withColumn("__kind", F.lit(1)).unionByName(
        beside.where("__me is not null"), allowMissingColumns=True
    )
    within = Window.partitionBy(*parts).orderBy("__kind", *[F.col(name).asc_nulls_first() for name in order])
    found = [
        function("__me").over(within)["value"].alias(name)
        for name, function in ((lag, F.lag), (lead, F.lead))
        if name is not None
    ]
    return carried.select(*df.columns, *found, "__kind").where("__kind = 1").drop("__kind")


def running_by_bucket(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Order,
    *,
    sums: dict[str, str] | None = None,
    count: str | None = None,
    count_down: str | None = None,
    way: str = "asc",
) -> DataFrame:
    """Running sums and row numbers per key, split by a leading order column.

    ``bucket`` is the first order column (a day, say), sorted ``way``. What
    other buckets add comes from an aggregate with one row per (keys,
    bucket); that row is put in front of its bucket's rows, so one window
    per (keys, bucket) gives the totals: one shuffle of the rows and no join.
    ``sums`` maps a value column to its running-sum name and ``count`` names
    the row number, both over ROWS in the given order. ``count_down`` names a
    row number that takes the buckets in reverse and keeps the order within
    each.
    """
    sums = sums or {}
    parts = [*keys, bucket]
    totals = df.groupBy(*parts).agg(
        F.count("*").alias("__rows"),
        *[F.sum(value).alias(f"__sum_{name}") for value, name in sums.items()],
    )
    kinds = {name: totals.schema[f"__sum_{name}"].dataType for name in sums.values()}
    by_bucket = Window.partitionBy(*keys).orderBy(*sort_columns([(bucket, way)]))
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    after = by_bucket.rowsBetween(1, Window.unboundedFollowing)
    counts = {}
    if count:
        counts[count] = before
    if count_down:
        counts[count_down] = after
    carry = totals.select(
        *parts,
        *[F.sum(f"__sum_{name}").over(before).cast(kinds[name]).alias(f"__v_{name}") for name in kinds],
        *[F.coalesce(F.sum("__rows").over(w), F.lit(0)).alias(f"__v_{name}") for name, w in counts.items()],
        F.lit(0).alias("__kind"),
    )
    rows = df.select(
        "*",
        *[F.col(value).cast(kinds[name]).alias(f"__v_{name}") for value, name in sums.items()],
        *[F.lit(1).cast("bigint").alias(f"__v_{name}") for name in counts],
        F.lit(1).alias("__kind"),
    )
    within = Window.partitionBy(*parts).orderBy("__kind", *sort_columns(order))
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.unionByName(carry, allowMissingColumns=True)
        .select(
            *df.columns,
            "__kind",
            *[F.sum(f"__v_{name}").over(within).cast(kinds[name]).alias(name) for name in kinds],
            *[F.sum(f"__v_{name}").over(within).alias(name) for name in counts],
        )
        .where(F.col("__kind") == 1)
        .drop("__kind")
    )
