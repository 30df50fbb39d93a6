"""Top rows overall and per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_with_ties(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n rows with the largest value and all rows equal to the last of them.

    The n-th value comes from a bounded sort; the rows are then filtered
    against that single value without being ranked.
    """
    first = df.select(value).orderBy(F.desc_nulls_last(value)).limit(n)
    last = first.agg(
        F.min(value).alias("__cut"), (F.count_if(F.col(value).isNull()) > 0).alias("__all")
    )
    reaches = (F.col(value) >= F.col("__cut")) | F.col("__all")
    return df.join(F.broadcast(last), reaches).drop("__cut", "__all")


def top_groups_per_key(df: DataFrame, key: str, group: str, value: str, n: int) -> DataFrame:
    """The n groups of largest summed value per key.

    Sums first, so the window sees one row per (key, group); groups are
    members of a dimension, which bounds the rows of one key.
    """
    sums = df.groupBy(key, group).agg(F.sum(value).alias("revenue"))
    rank = Window.partitionBy(key).orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_first(group))
    return sums.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= n).drop("__rank")
