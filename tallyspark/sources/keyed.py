"""Tables split by a hash of their key, changed by rewriting the parts that a change touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.changes import merge_upsert, update_where
from tallyspark.session import materialise

_PART = "__part"


class KeyedTable:
    """Parquet files in one folder per part; a key lies in the part its hash names.

    A change reads the touched parts, writes their new rows to the shared folder,
    and overwrites those folders alone. Other files stay as they are. Parts are
    replaced one by one, so a failure may leave some old and some new; the same
    change, run again, ends in the same rows.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], parts: int = 64):
        self.spark, self.path, self.keys, self.parts = spark, path, list(keys), parts

    def _parted(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_PART, F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        (
            rows.hint("rebalance", _PART)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(_PART)
            .parquet(self.path)
        )

    def create(self, df: DataFrame) -> None:
        self._write(self._parted(df))

    def _all(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().drop(_PART)

    def _touched(self, parts: DataFrame) -> DataFrame:
        """Rows of some parts; one row per part, so the broadcast is bounded and prunes folders."""
        return self._all().join(F.broadcast(parts), _PART, "left_semi")

    def merge(self, source: DataFrame) -> DataFrame:
        """Source rows replace rows of the same key, others are added; one row: inserted, updated.

        NULL keys equal nothing, so such rows are added. Source rows that repeat
        a key are all kept.
        """
        rows = materialise(self._parted(source), "merge-source")
        old = self._touched(rows.select(_PART).distinct())
        keys = old.select(*self.keys).distinct().withColumn("__old", F.lit(True))
        matched = rows.join(keys, self.keys, "left")
        counts = materialise(
            matched.agg(
                F.count_if(F.col("__old").isNull()).alias("inserted"), F.count_if("__old").alias("updated")
            ),
            "merge-counts",
        )
        self._write(materialise(merge_upsert(old, rows, self.keys), "merged"))
        return counts

    def update(self, condition: Column, **values: Column) -> DataFrame:
        """UPDATE ... SET ... WHERE on columns other than the key; one row: updated."""
        changed = {name for name in values if name in self.keys}
        if changed:
            raise ValueError(f"keys cannot be updated: {sorted(changed)}")
        hits = materialise(self._all().where(condition).groupBy(_PART).agg(F.count("*").alias("n")), "update-parts")
        old = self._touched(hits.select(_PART))
        self._write(materialise(update_where(old, condition, **values), "updated"))
        return hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("updated"))
