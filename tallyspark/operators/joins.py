"""Joins with dimensions and with dated rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a task that keeps nearly all of them in memory.
TASK_ROWS = 400_000


def partitions_for(df: DataFrame, rows: int | None = None) -> int:
    """Partitions that leave a task about ``rows`` rows, by one count of the table.

    Spark sizes tasks by compressed bytes, and a few narrow columns of many
    rows compress so well that a task gets millions of them.
    """
    return max(1, -(-df.count() // (rows or TASK_ROWS)))


def join_dimension(facts: DataFrame, dimension: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a table expected to be small.

    Spark broadcasts it if its size, known from statistics or at run time, is
    below the session's limit. Otherwise it is shuffled and, under AQE, split
    where a key is hot.
    """
    return facts.join(dimension, on, how)


def effective_on(day: Column, effective: Column, expiry: Column) -> Column:
    """A dated rule holds on a day; an open end never expires."""
    return (effective <= day) & (expiry.isNull() | (expiry >= day))


def join_effective_date(
    facts: DataFrame, rules: DataFrame, keys: Sequence[tuple[str, str]], day: str, how: str = "left"
) -> DataFrame:
    """Equal keys plus validity on the day; one row per matching rule.

    ``rules`` holds ``effective_date`` and ``expiry_date``; ``keys`` pairs a
    fact column with a rule column.
    """
    condition = effective_on(F.col(day), F.col("effective_date"), F.col("expiry_date"))
    for fact, rule in keys:
        condition = condition & (F.col(fact) == F.col(rule))
    return join_dimension(facts, rules, condition, how)


#: Days are counted from far enough back to be positive, and a rule's days are cut into blocks of 2**level.
_FIRST_DAY, _LEVELS = 1 << 20, 22
_LAST_DAY = (1 << _LEVELS) - 1


def _day_number(day: Column) -> Column:
    return F.unix_date(day.cast("date")) + F.lit(_FIRST_DAY)


def _blocks(first: Column, last: Column) -> Column:
    """The fewest aligned blocks of days that cover ``first`` to ``last``: at most two of each level."""

    def of_level(level: Column) -> Column:
        def inside(up: Column) -> tuple[Column, Column]:
            size = F.call_function("shiftleft", F.lit(1).cast("bigint"), up)
            return F.floor((first + size - 1) / size), F.floor((last + 1) / size) - 1

        low, high = inside(level)
        low_above, high_above = inside(level + 1)
        ends = F.array_distinct(F.array(low, high))

        def is_largest(block: Column) -> Column:
            above = F.floor(block / 2)
            return (block >= low) & (block <= high) & ~((above >= low_above) & (above <= high_above))

        chosen = F.filter(ends, is_largest)
        return F.transform(chosen, lambda block: F.struct(level.alias("level"), block.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), of_level))


def best_rule_per_day(
    facts: DataFrame,
    rules: DataFrame,
    keys: Sequence[tuple[str, str]],
    wildcards: Sequence[tuple[str, str]],
    day: str,
    rule_columns: Sequence[str],
) -> DataFrame:
    """One rule per fact row: the most specific, then the newest, then the lowest id.

    ``wildcards`` are rule columns where NULL matches anything, the first
    being the most telling. A rule's days are cut into aligned blocks, the best
    rule of each (keys, wildcards, block) is kept by an aggregate, and a day
    lies in one block of each size. So the distinct (keys, wildcards, day) of the
    facts find their rule by equality, whatever the number of rules of a key;
    facts are joined with the answers and never multiplied. NULL keys match
    nothing.
    """
    names = [*[f"__k{i}" for i in range(len(keys))], *[f"__w{i}" for i in range(len(wildcards))]]
    columns = [F.col(rule) for _, rule in [*keys, *wildcards]]
    first = _day_number(F.col("effective_date"))
    last = F.coalesce(_day_number(F.col("expiry_date")), F.lit(_LAST_DAY))
    best = F.struct(
        *[F.col(rule).isNull().cast("int").alias(f"s{i}") for i, (_, rule) in enumerate(wildcards)],
        (-F.unix_date(F.col("effective_date").cast("date"))).alias("age"),
        F.col("rule_id").alias("rule_id"),
        F.struct(*rule_columns).alias("found"),
    )
    held = (
        rules.where(all_of_known([rule for _, rule in keys]) & (first <= last))
        .select(*[column.alias(name) for column, name in zip(columns, names, strict=True)], best.alias("__best"), F.explode(_blocks(first, last)).alias("b"))
        .groupBy(*names, F.col("b.level").alias("__level"), F.col("b.block").alias("__block"))
        .agg(F.min("__best").alias("__best"))
    )
    asked = [F.col(fact).alias(name) for (fact, _), name in zip([*keys, *wildcards], names, strict=True)]
    asks = (
        facts.select(*asked, _day_number(F.col(day)).alias("__day"))
        .where(all_of_known([*names[: len(keys)], "__day"]))
        .distinct()
    )
    # a rule may leave any of the wildcards open
    patterns = F.array(
        *[
            F.struct(
                *[
                    (F.lit(None).cast(asks.schema[f"__w{i}"].dataType) if mask >> i & 1 else F.col(f"__w{i}")).alias(f"p{i}")
                    for i in range(len(wildcards))
                ],
                F.lit(mask).alias("mask"),
            )
            for mask in range(1 << len(wildcards))
        ]
    )
    levels = F.sequence(F.lit(0), F.lit(_LEVELS))
    probes = asks.select("*", F.explode(patterns).alias("p")).select(
        "*",
        F.explode(F.transform(levels, lambda up: F.struct(up.alias("level"), F.floor(F.col("__day") / F.call_function("shiftleft", F.lit(1).cast("bigint"), up)).alias("block")))).alias("b"),
    )
    matches = (F.col("b.level") == F.col("h.__level")) & (F.col("b.block") == F.col("h.__block"))
    for i in range(len(keys)):
        matches = matches & (F.col(f"a.__k{i}") == F.col(f"h.__k{i}"))
    for i in range(len(wildcards)):
        matches = matches & F.col(f"p.p{i}").eqNullSafe(F.col(f"h.__w{i}"))
        # a fact without a value is met by open rules alone, once
        known = F.col(f"a.__w{i}").isNotNull()
        matches = matches & (known | (F.col("p.mask").bitwiseAND(F.lit(1 << i)) != 0))
    answers = (
        probes.alias("a")
        .join(held.alias("h"), matches)
        .groupBy(*[F.col(f"a.{name}").alias(f"__r{name}") for name in names], F.col("__day").alias("__rday"))
        .agg(F.min("__best").alias("__found"))
    )
    same = _day_number(F.col(day)) == F.col("__rday")
    for (fact, _), name in zip([*keys, *wildcards], names, strict=True):
        same = same & F.col(fact).eqNullSafe(F.col(f"__r{name}"))
    return join_dimension(facts, answers, same, "left").select(
        *facts.columns,
        F.col("__found.rule_id").alias("rule_id"),
        *[F.col(f"__found.found.{name}").alias(name) for name in rule_columns],
    )


def all_of_known(names: Sequence[str]) -> Column:
    """No column of these is NULL."""
    known = F.lit(True)
    for name in names:
        known = known & F.col(name).isNotNull()
    return known


def join_not_in(df: DataFrame, column: str, excluded: DataFrame, other: str) -> DataFrame:
    """Rows whose ``column`` is NOT IN the values of ``other``, by the rules of SQL.

    Against no values every row stays. A NULL among the values leaves no row,
    and a NULL row stays only against no values. Whether there are values, and
    a NULL among them, is one row; the rest is an anti join by key, so the
    values need not fit a broadcast.
    """
    flags = excluded.agg(
        F.count("*").alias("__values"), F.count_if(F.col(other).isNull()).alias("__nulls")
    )
    values = excluded.select(F.col(other).alias("__value")).where("__value is not null").distinct()
    kept = df.join(F.broadcast(flags)).where(
        (F.col("__values") == 0) | ((F.col("__nulls") == 0) & F.col(column).isNotNull())
    )
    return kept.join(values, F.col(column) == F.col("__value"), "left_anti").select(*df.columns)
