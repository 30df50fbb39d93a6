"""Exact distinct counts by levels: rows are counted, lines are never copied.

Several ``count(DISTINCT ...)`` in one aggregate make Spark copy every row once
for each of them. Where one column nests in another, as orders in customers,
rows can be counted instead: group by the finer columns, keep the set of the
column that does not nest, and turn the sets into rows again for the next level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(rows: DataFrame, members: str, member: str, once: Sequence[str]) -> DataFrame:
    """One row per member of the array ``members``, or one without a member if it is empty.

    The columns ``once`` keep their value on the first of them and are NULL on
    the others, so that sums over the new rows stay right.
    """
    others = [name for name in rows.columns if name not in (members, *once)]
    exploded = rows.select(*others, *once, F.posexplode_outer(members).alias("__at", member))
    first = F.coalesce("__at", F.lit(0)) == 0
    return exploded.select(*others, member, *[F.when(first, F.col(name)).alias(name) for name in once])
