"""Run log: steps of a run with times, appended in one write."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import SparkSession

from tallyspark.sources.files import append_rows

SCHEMA = (
    "run_id string, proc_name string, step_name string, step_status string, message string, "
    "started_utc timestamp, completed_utc timestamp"
)


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


class RunLog:
    """Collects the steps of one run and appends them once, when the run ends.

        with RunLog(spark, "daily", path) as log:
            log.step("lines", "OK")

    An error is logged as a FAIL step and raised again. ``complete`` marks a
    step as finished at the time it is logged.
    """

    def __init__(self, spark: SparkSession, proc_name: str, path: str, start_message: str | None = None):
        self.spark, self.proc_name, self.path = spark, proc_name, path
        self.run_id = str(uuid.uuid4())
        self.rows: list[tuple] = []
        self.start_message = start_message

    def step(self, name: str, status: str, message: str | None = None, complete: bool = False) -> None:
        now = _now()
        self.rows.append(
            (self.run_id, self.proc_name, name, status, message, now, now if complete else None)
        )

    def flush(self) -> None:
        # one small file per run, whatever the number of steps
        append_rows(self.spark.createDataFrame(self.rows, SCHEMA).coalesce(1), self.path)
        self.rows = []

    def __enter__(self) -> "RunLog":
        self.step("START", "START", self.start_message)
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if error is None:
            self.step("END", "SUCCESS", "Completed", complete=True)
        else:
            self.step("END", "FAIL", f"Error {kind.__name__}: {error}", complete=True)
        self.flush()
        return False
