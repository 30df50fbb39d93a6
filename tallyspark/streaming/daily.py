"""Daily summary of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import fresh_path
from tallyspark.sources.tables import SCHEMAS

c = F.col
DELAY = "2 days"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Event files of a folder as a stream; event time carries a zone there."""
    reader = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "*.parquet")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def summarise(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Totals per day. As a stream, a day is closed once the watermark passes its end.

    The same plan summarises a batch, where the watermark has no effect.
    """
    timed = events.withColumn("event_time", c("ts").cast("timestamp"))
    amount = c("value").cast("decimal(18,2)")
    return (
        timed.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day"))
        .agg(
            F.count("*").alias("events"),
            F.sum(amount).alias("total"),
            F.min(amount).alias("smallest"),
            F.max(amount).alias("largest"),
            F.sum(F.when(c("event_type") == "purchase", 1).otherwise(0)).alias("purchases"),
        )
        .select(c("window.start").cast("date").alias("day"), "events", "total", "smallest", "largest", "purchases")
    )


def run_once(summary: DataFrame, spark: SparkSession, label: str = "daily", folder: str | None = None) -> DataFrame:
    """Process what is there, append closed days to a table, and read it.

    ``folder`` holds the days, one table per batch, and the progress. A run over
    the same folder goes on where the last one stopped; a batch that is run
    again replaces its own days. Without it each run has its own folder.
    """
    folder = folder or fresh_path(spark, label)

    def append(days: DataFrame, batch: int) -> None:
        days.write.mode("overwrite").parquet(f"{folder}/days/batch={batch}")

    stream = (
        summary.writeStream.foreachBatch(append)
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return spark.read.schema(summary.schema).parquet(f"{folder}/days").select(*summary.columns)
