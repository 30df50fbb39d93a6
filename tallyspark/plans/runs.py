"""The three workloads as logged runs: each step is written, counted and logged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.runlog import RunLog
from tallyspark.session import materialise

Steps = list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]


def logged_run(spark: SparkSession, name: str, steps: Steps, log_path: str) -> dict[str, DataFrame]:
    """Run the steps in order; each takes the frames made so far and is read from its written table.

    A step's row count is its message. A step that fails is logged by the run
    and raised again; the steps before it stay logged.
    """
    made: dict[str, DataFrame] = {}
    with RunLog(spark, name, log_path) as log:
        for step, make in steps:
            made[step] = materialise(make(made), step, "zstd")
            log.step(step, "OK", f"Rows: {made[step].count()}", complete=True)
    return made
