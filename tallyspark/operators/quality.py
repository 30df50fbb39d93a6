"""Rules kept as text, constraints, and what breaks them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Predicates evaluated in one pass over the data.
PER_PASS = 300

_WORDS = {"and", "or", "not", "is", "null", "in", "between", "like", "true", "false", "abs", "coalesce", "nullif"}
_TOKEN = re.compile(r"\s*('(?:[^'])*'|\d+(?:\.\d+)?|[A-Za-z_]\w*|<=|>=|<>|!=|[-+*/%=<>(),])")


class RejectedPredicate(ValueError):
    """A stored predicate holds something other than columns, numbers and plain operators."""


def predicate(text: str, columns: Sequence[str]) -> Column:
    """A stored predicate as a column, if every word in it is allowed.

    Allowed are the frame's columns, literals, comparison and arithmetic
    signs, and the words above. Anything else (a subquery, another function,
    a comment) is refused before Spark sees the text.
    """
    allowed = _WORDS | {name.lower() for name in columns}
    at = 0
    while at < len(text.rstrip()):
        found = _TOKEN.match(text, at)
        if found is None:
            raise RejectedPredicate(f"{text!r}: unexpected text at {at}")
        word = found.group(1)
        if re.match(r"[A-Za-z_]", word) and word.lower() not in allowed:
            raise RejectedPredicate(f"{text!r}: {word!r} is not allowed")
        at = found.end()
    return F.expr(text)


def evaluate(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with ``failed``: whether any row of ``df`` satisfies the predicate.

    Rules share predicates, so the distinct texts are evaluated together,
    ``PER_PASS`` in one pass over ``df``, and joined back.
    """
    texts = sorted(row[0] for row in rules.select("predicate").distinct().collect())
    outcome = _outcome(df, texts[:PER_PASS])
    for start in range(PER_PASS, len(texts), PER_PASS):
        outcome = outcome.union(_outcome(df, texts[start : start + PER_PASS]))
    return rules.join(outcome, "predicate")  # one row per distinct predicate


def _outcome(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """(predicate, failed) for some predicates."""
    if not texts:
        return df.sparkSession.createDataFrame([], "predicate string, failed boolean")
    hits = df.agg(
        *[
            F.coalesce(F.bool_or(predicate(text, df.columns)), F.lit(False)).alias(f"p{i}")
            for i, text in enumerate(texts)
        ]
    )
    return hits.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(text).alias("predicate"), F.col(f"p{i}").alias("failed"))
                    for i, text in enumerate(texts)
                ]
            )
        ).alias("o")
    ).select("o.*")


def fail_counts(results: DataFrame) -> DataFrame:
    """One row: failed rules of severity 1, 2 and 3."""
    failed = F.col("failed")
    return results.agg(
        *[F.count_if(failed & (F.col("severity") == s)).alias(f"severity_{s}") for s in (1, 2, 3)]
    )


# --- constraints -----------------------------------------------------------------------


def _violation(df: DataFrame, kind: str, name: str, key: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("constraint_kind"), F.lit(name).alias("constraint_name"), key.cast("string").alias("row_key")
    )


def not_null(df: DataFrame, column: str, key: str) -> DataFrame:
    return _violation(df.where(F.col(column).isNull()), "NOT NULL", column, F.col(key))


def check(df: DataFrame, name: str, condition: Column, key: str) -> DataFrame:
    """CHECK: broken only where the condition is false; NULL passes."""
    return _violation(df.where(~condition), "CHECK", name, F.col(key))


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per key that occurs more than once."""
    repeated = df.groupBy(*columns).agg(F.count("*").alias("__n")).where("__n > 1")
    return _violation(repeated, "UNIQUE", ",".join(columns), F.concat_ws("|", *columns))


def foreign_key(df: DataFrame, column: str, parent: DataFrame, parent_key: str, key: str) -> DataFrame:
    """Rows whose value has no parent; NULL is no reference."""
    keys = parent.select(F.col(parent_key).alias("__parent"))
    orphans = df.where(F.col(column).isNotNull()).join(
        keys, F.col(column) == F.col("__parent"), "left_anti"
    )
    return _violation(orphans, "FOREIGN KEY", column, F.col(key))
