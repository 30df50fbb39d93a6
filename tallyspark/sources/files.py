"""Files in and out."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPLOYEES = "id int, name string, department string, salary int, joining_date date"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header row as typed columns; a cell of the wrong type is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[
            F.to_json(field.name).alias(field.name)
            if isinstance(field.dataType, nested)
            else F.col(field.name)
            for field in df.schema
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """One flat result as a folder of CSV files, each written by its own task."""
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def reload_table(df: DataFrame, path: str) -> None:
    """Empty a reference table and fill it again."""
    df.write.mode("overwrite").parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def publish(df: DataFrame, path: str) -> None:
    """All or nothing: write beside the target, then rename to it.

    The target must not exist yet; readers see either no table or all of it.
    The folder beside it is gone afterwards, whatever happens. A rename is
    atomic on HDFS and local file systems; elsewhere use ``commit``.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        df.write.mode("errorifexists").parquet(staging)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        source, target = hadoop.Path(staging), hadoop.Path(path)
        files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(target) or not files.rename(source, target):
            raise FileExistsError(path)
    finally:
        _remove(spark, staging)


_MANIFEST = "version long, id string, file string, bytes long"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/manifest")


def commit(df: DataFrame, path: str) -> str:
    """A new version of the table at ``path``, all or nothing on any store; returns its id.

    Data files are written first, then one manifest file that names them. That
    single file is the commit: readers use the files of the last manifest, so
    they see the old version or the new one, and files of a write that failed,
    or of a task that ran twice, are never read. Nothing is renamed. One writer
    at a time. A write that fails leaves no file.
    """
    spark, key, root = df.sparkSession, uuid.uuid4().hex, path.rstrip("/")
    done = False
    try:
        # an empty manifest makes the folder, so that the first version needs no test for it
        spark.createDataFrame([], _MANIFEST).write.mode("append").parquet(f"{root}/manifest")
        df.write.parquet(f"{root}/data/{key}")
        named = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{root}/data/{key}")
        last = _manifest(spark, root).agg(F.coalesce(F.max("version"), F.lit(0)).alias("last"))
        rows = named.select("path", "length").join(F.broadcast(last))
        rows.select(
            (F.col("last") + 1).alias("version"),
            F.lit(key).alias("id"),
            F.col("path").alias("file"),
            F.col("length").alias("bytes"),
        ).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
        done = True
    finally:
        if not done:
            _remove(spark, f"{root}/data/{key}")
    return key


def read_committed(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The last version of a table written by ``commit``, or the one with this id."""
    manifest = _manifest(spark, path)
    if key is None:
        newest = manifest.agg(F.max(F.struct("version", "id")).alias("v")).select("v.id")
        chosen = manifest.join(F.broadcast(newest), "id", "left_semi")
    else:
        chosen = manifest.where(F.col("id") == key)
    # one name per data file
    names = [row["file"] for row in chosen.select("file").collect()]
    if not names:
        raise FileNotFoundError(path)
    return spark.read.parquet(*names)
