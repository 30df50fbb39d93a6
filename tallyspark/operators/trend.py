"""Least-squares trend over calendar totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linear_trend(totals: DataFrame, calendar: Sequence[str], value: str) -> DataFrame:
    """One row: points, mean and slope of ``value`` against its calendar position.

    ``totals`` holds one row per month (or quarter, ...), so its number of
    rows is bounded by the calendar and one window may hold them all.
    The slope is NULL with fewer than two points.
    """
    position = F.row_number().over(Window.orderBy(*calendar)).cast("double")
    points = totals.select(position.alias("x"), F.col(value).cast("double").alias("y"))
    return points.agg(
        F.count("*").alias("points"), F.avg("y").alias("mean"), F.regr_slope("y", "x").alias("slope")
    )
