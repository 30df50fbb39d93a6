"""NTILE from its cut rows: the last row of every tile, found without sorting all rows.

A sketch of the leading order column brackets every cut. One aggregate counts
the rows before each bracket, and only rows inside brackets, a few in a
thousand with the order columns alone, are sorted to name the cut row exactly.
Every row is then compared with the cut rows, which travel as one row. Several
scores share the passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.ranking import Order, keyed_row_number

#: The sketch's rank error is at most one in ACCURACY; brackets reach MARGIN to both sides.
ACCURACY = 10_000
MARGIN = 0.002


def _sketched(df: DataFrame, order: Order) -> Column:
    """A double that never falls along the order: the leading column, NULLs and direction included."""
    name, way = order[0]
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DateType):
        value = F.unix_date(value)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(value.cast("timestamp"))
    elif not isinstance(kind, (T.NumericType, T.BooleanType)):
        raise ValueError(f"{name}: the leading order column must be a number, a date or a time")
    number = F.nanvl(value.cast("double"), F.lit(float("inf")))
    number = -number if way == "desc" else number
    # NULL sorts first ascending and last descending
    return F.coalesce(number, F.lit(float("inf" if way == "desc" else "-inf")))


def _behind(order: Order, row: Column, cut: Column) -> Column:
    """Whether a row sorts behind a cut row."""
    behind = F.lit(False)
    for name, way in reversed(order):
        a, b = row[name], cut[name]
        above = (a < b) | (a.isNull() & b.isNotNull()) if way == "desc" else (a > b) | (a.isNotNull() & b.isNull())
        behind = F.coalesce(above, F.lit(False)) | (a.eqNullSafe(b) & behind)
    return behind


def _last_rank(tile: int, tiles: int) -> Column:
    """Row number of the last row of a tile, from the row count ``__n``: the first ``n mod tiles`` are one longer."""
    short = F.floor(F.col("__n") / tiles)
    return tile * short + F.least(F.lit(tile).cast("bigint"), F.col("__n") % tiles)


def with_tiles(df: DataFrame, scores: dict[str, tuple[Order, int]]) -> DataFrame:
    """Rows with one NTILE column per score: name -> (order, tiles).

    Meant for tens of tiles over a table that is cheap to read: the order
    columns are read three times, all columns once. The order should be unique;
    rows equal in all of its columns share a tile. A leading value that many
    rows share makes its bracket as large as their number; those rows are
    sorted by range on the order columns alone.
    """
    # a column decides where it stands first
    scores = {
        name: ([(column, way) for i, (column, way) in enumerate(order) if column not in [c for c, _ in order[:i]]], tiles)
        for name, (order, tiles) in scores.items()
    }
    cuts = [(name, tile) for name, (_, tiles) in scores.items() for tile in range(1, tiles)]
    if not cuts:
        return df.withColumns({name: F.lit(1).cast("bigint") for name in scores})
    slim = df.select(*dict.fromkeys(column for order, _ in scores.values() for column, _ in order))
    keyed = slim.withColumns({f"__x_{name}": _sketched(df, order) for name, (order, _) in scores.items()})

    # one row: a bracket of leading values around every cut
    sketches = {}
    for name, (_, tiles) in scores.items():
        middle = [tile / tiles for tile in range(1, tiles)]
        shares = [min(1.0, max(0.0, m + side)) for m in middle for side in (-MARGIN, MARGIN)]
        sketches[name] = F.percentile_approx(f"__x_{name}", shares, ACCURACY).alias(f"__q_{name}")
    guesses = keyed.agg(*sketches.values())

    def bracket(name: str, tile: int) -> tuple[Column, Column]:
        return F.col(f"__q_{name}")[2 * tile - 2], F.col(f"__q_{name}")[2 * tile - 1]

    counts = []
    for name, tile in cuts:
        low, high = bracket(name, tile)
        x = F.col(f"__x_{name}")
        counts.append(F.count_if(x < low).alias(f"__below_{name}_{tile}"))
        counts.append(F.count_if(x <= high).alias(f"__within_{name}_{tile}"))
    counted = keyed.join(F.broadcast(guesses)).agg(
        F.count("*").alias("__n"), *counts, *[F.first(f"__q_{name}").alias(f"__q_{name}") for name in scores]
    )
    # a bracket that misses its cut is opened, so the sketch decides the cost and never the result
    plan = counted.select(
        *[
            F.struct(
                (_last_rank(tile, scores[name][1]) - F.when(missed_low, 0).otherwise(F.col(below))).alias("rank"),
                F.when(missed_low, F.lit(float("-inf"))).otherwise(bracket(name, tile)[0]).alias("low"),
                F.when(missed_high, F.lit(float("inf"))).otherwise(bracket(name, tile)[1]).alias("high"),
            ).alias(f"__cut_{name}_{tile}")
            for name, tile in cuts
            for below in [f"__below_{name}_{tile}"]
            for rank in [_last_rank(tile, scores[name][1])]
            for missed_low in [F.col(below) >= rank]
            for missed_high in [F.col(f"__within_{name}_{tile}") < rank]
        ]
    )

    named = []
    for name, (order, tiles) in scores.items():
        x, columns = F.col(f"__x_{name}"), [column for column, _ in order]
        members = [
            F.when(
                (x >= F.col(f"__cut_{name}_{tile}.low")) & (x <= F.col(f"__cut_{name}_{tile}.high")),
                F.struct(F.lit(tile).alias("tile"), F.col(f"__cut_{name}_{tile}.rank").alias("rank")),
            )
            for tile in range(1, tiles)
        ]
        inside = (
            keyed.join(F.broadcast(plan))
            .select(*columns, F.explode(F.filter(F.array(*members), lambda m: m.isNotNull())).alias("__in"))
            .select(*columns, F.col("__in.tile").alias("__tile"), F.col("__in.rank").alias("__rank"))
        )
        at_cut = keyed_row_number(inside, ["__tile"], order, "__at").where("__at = __rank")
        row = F.struct(*columns)
        # at most one row a cut
        named.append(
            at_cut.agg(*[F.max(F.when(F.col("__tile") == tile, row)).alias(f"__row_{name}_{tile}") for tile in range(1, tiles)])
        )
    rows = reduce(lambda a, b: a.join(F.broadcast(b)), named)

    def tile_of(name: str) -> Column:
        order, tiles = scores[name]
        row = F.struct(*[column for column, _ in order])
        tile = F.lit(1).cast("bigint")
        for number in range(1, tiles):
            cut = F.col(f"__row_{name}_{number}")
            tile = tile + F.when(cut.isNotNull() & _behind(order, row, cut), 1).otherwise(0)
        return tile

    return df.join(F.broadcast(rows)).select(*df.columns, *[tile_of(name).alias(name) for name in scores])
