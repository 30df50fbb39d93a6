"""Change audit of a stream of row images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.changes import changed_fields
from tallyspark.operators.ranking import Order, with_neighbours
from tallyspark.session import fresh_path


class AuditStream:
    """Audits each micro-batch against all earlier images of its keys.

    Images are kept in the shared folder, one table per batch, so an image
    that arrives late finds its place: it is audited against the one before
    it, and the one after it is audited again. ``repaired`` names such images
    by key and order; their rows of earlier batches no longer count. A batch
    that is run again reads the same earlier tables and replaces its own
    output, so a failure leaves no duplicates. A key's images are paired by a
    distributed row number, so a busy key is not held by one task. The kept
    images grow with the stream, and each batch reads them.
    """

    def __init__(
        self, spark: SparkSession, key: str, order: Order, fields: dict[str, str | None], keep: list[str]
    ):
        self.spark, self.key, self.order = spark, key, list(order)
        self.fields, self.keep = fields, keep
        self.root = fresh_path(spark, "audit")
        self.columns = list(dict.fromkeys([key, *[n for n, _ in order], *keep, *fields]))

    def _images(self, batch_id: int) -> str:
        return f"{self.root}/images/{batch_id}"

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        batch.select(*self.columns).write.mode("overwrite").parquet(self._images(batch_id))
        images = self.spark.read.parquet(self._images(batch_id))
        keys = images.select(self.key).distinct()
        images = images.withColumn("is_new", F.lit(True))
        if batch_id > 0:
            earlier = self.spark.read.parquet(*[self._images(i) for i in range(batch_id)])
            earlier = earlier.join(keys, self.key, "left_semi").select(*self.columns)
            images = images.unionByName(earlier.withColumn("is_new", F.lit(False)))
        place = list(dict.fromkeys([self.key, *[name for name, _ in self.order]]))
        names = list(dict.fromkeys([*place, *self.keep]))
        placed = images.select(*names, F.struct(*self.fields, "is_new").alias("new"))
        paired = with_neighbours(placed, [self.key], self.order, "new", "old", None)
        touched = paired.where("old is not null and (new.is_new or old.is_new)")
        changed_fields(touched, self.fields, names).write.mode("overwrite").parquet(
            f"{self.root}/audit/batch={batch_id}"
        )
        touched.where("not new.is_new").select(*place).write.mode("overwrite").parquet(
            f"{self.root}/repaired/batch={batch_id}"
        )

    def audit(self) -> DataFrame:
        """The rows of all batches, without those of pairs that a late image has parted since."""
        rows = self.spark.read.parquet(f"{self.root}/audit").alias("a")
        repaired = self.spark.read.parquet(f"{self.root}/repaired").alias("r")
        place = dict.fromkeys([self.key, *[name for name, _ in self.order]])
        later = F.col("r.batch") > F.col("a.batch")
        for name in place:
            later = later & F.col(f"a.{name}").eqNullSafe(F.col(f"r.{name}"))
        return rows.join(repaired, later, "left_anti").select(
            *self.keep, "field_changed", "old_value", "new_value"
        )

    def run_once(self, stream: DataFrame) -> DataFrame:
        query = (
            stream.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", f"{self.root}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.audit()
