"""Session settings and the shared folder that survives executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested with.

    Every plan also runs on a session built elsewhere: nothing depends on
    these values for right results.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.decimalOperations.allowPrecisionLoss", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # HotSpot leaves generated methods above 8000 bytes of bytecode interpreted;
        # beyond that size plain operators are faster
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests, a laptop) gets a fresh
    temporary folder; a cluster gets an error, because a folder on one
    machine would be lost with that machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyspark-"))
        folder = context.getCheckpointDir()
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "stage", compression: str | None = None) -> DataFrame:
    """Write to the shared folder and read back, which cuts lineage.

    The table outlives lost executors, is read by column, and has a known
    size, so later joins with it can be planned from that. It stays until
    the folder's owner expires it. ``compression`` names a Parquet codec other
    than the session's.
    """
    path = fresh_path(df.sparkSession, label)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
