"""Sources, sinks, logs, streams."""

import datetime as dt
import subprocess
import sys

import pytest
from conftest import DATA, ROOT
from pyspark.sql import functions as F

from tallyspark.catalog.procedures import _FIELDS, _IMAGE_ORDER, _images
from tallyspark.operators import changes
from tallyspark.runlog import RunLog
from tallyspark.session import materialise, shared_dir
from tallyspark.sources import Tables, files, load
from tallyspark.sources.tables import SchemaMismatch
from tallyspark.streaming import audit, daily


def test_schema_is_checked(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "region.parquet"))
    with pytest.raises(SchemaMismatch, match="r_regionkey"):
        load(spark, str(tmp_path), "region")


def test_catalog_table(spark):
    Tables(spark, DATA).region.createOrReplaceTempView("region")
    assert load(spark, None, "region").count() == 5


def test_csv_cell_of_the_wrong_type_is_an_error(spark, tmp_path):
    spark.createDataFrame([("x",)], "id string").write.option("header", True).csv(str(tmp_path / "c"))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        files.read_csv(spark, str(tmp_path / "c"), "id int").collect()


def test_publish_is_all_or_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    files.publish(spark.range(3), target)
    assert spark.read.parquet(target).count() == 3
    with pytest.raises(FileExistsError):
        files.publish(spark.range(9), target)
    assert spark.read.parquet(target).count() == 3
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        files.publish(broken, str(tmp_path / "u"))
    assert not (tmp_path / "u").exists()


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    with RunLog(spark, "p", path) as log:
        log.step("a", "OK", "m" * 3000)
    with pytest.raises(ZeroDivisionError), RunLog(spark, "p", path):
        1 / 0
    rows = spark.read.parquet(path)
    assert rows.select("run_id").distinct().count() == 2
    assert rows.agg(F.max(F.length("message"))).first()[0] == 3000
    failed = rows.where("step_status = 'FAIL'").first()
    assert failed["step_name"] == "END" and "ZeroDivisionError" in failed["message"]
    assert failed["completed_utc"] is not None


def test_materialise_cuts_lineage_in_the_shared_folder(spark):
    df = materialise(spark.range(10).withColumn("d", F.col("id").cast("decimal(19,4)")))
    plan = df._jdf.queryExecution().toString()
    assert "Range" not in plan and df.schema["d"].dataType.simpleString() == "decimal(19,4)"
    assert shared_dir(spark) == shared_dir(spark)


def test_shared_folder_of_the_session_is_used(tmp_path):
    """The folder is fixed when a session starts, so this takes a session of its own."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from tallyspark.session import build_session, materialise, shared_dir
spark = build_session("shared", "local[1]", **{{"spark.checkpoint.dir": {str(tmp_path)!r}, "spark.ui.enabled": "false"}})
assert shared_dir(spark) == {str(tmp_path)!r}
assert materialise(spark.range(3), "three").count() == 3
assert materialise(spark.range(4), "four", "zstd").count() == 4
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert {p.name.split("-")[0] for p in tmp_path.iterdir() if p.is_dir()} >= {"three", "four"}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, getCheckpointDir = "spark://host", staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def _batches(spark, tmp_path, parts):
    folder = str(tmp_path / "events")
    for part in parts:
        part.write.mode("append").parquet(folder)
    return folder


def test_audit_over_several_batches(spark, tmp_path):
    events = Tables(spark, DATA).events
    cut = events.agg(F.expr("approx_percentile(event_id, array(0.3, 0.7))")).first()[0]
    parts = [
        events.where(F.col("event_id") < cut[0]).coalesce(1),
        events.where((F.col("event_id") >= cut[0]) & (F.col("event_id") < cut[1])).coalesce(1),
        events.where(F.col("event_id") >= cut[1]).coalesce(1),
    ]
    folder = _batches(spark, tmp_path, parts)
    keep = ["event_id", "user_id"]
    auditor = audit.AuditStream(spark, "user_id", _IMAGE_ORDER, _FIELDS, keep)
    streamed = auditor.run_once(_images(daily.read_events(spark, folder, files_per_trigger=1)))
    expected = changes.audit_feed(_images(events), "user_id", _IMAGE_ORDER, _FIELDS, keep)
    key = str
    columns = expected.columns
    assert sorted(map(tuple, streamed.select(columns).collect()), key=key) == sorted(
        map(tuple, expected.collect()), key=key
    )
    before = streamed.count()
    auditor.apply(_images(parts[2]), 2)  # a batch that is run again replaces its output
    assert spark.read.parquet(f"{auditor.root}/audit").count() == before


def test_audit_places_images_that_arrive_late(spark):
    fields, order = {"status": None}, [("ts", True), ("id", True)]
    images = [(1, 10, 1, "b"), (2, 5, 1, "a"), (3, 20, 1, "c"), (4, 15, 1, "c"), (5, 7, 2, "x")]
    feed = spark.createDataFrame(images, "id int, ts int, user_id int, status string")
    order = [(name, _IMAGE_ORDER[0][1]) for name, _ in order]
    auditor = audit.AuditStream(spark, "user_id", order, fields, ["id", "user_id"])
    for batch, image in enumerate(images):
        auditor.apply(feed.where(F.col("id") == image[0]), batch)
    expected = changes.audit_feed(feed, "user_id", order, fields, ["id", "user_id"])
    found = auditor.audit()
    assert found.columns == expected.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert sorted(r.id for r in expected.collect()) == [1, 4]


def test_late_rows_are_dropped(spark, tmp_path):
    def event(i, day):
        return (i, dt.datetime(2024, 1, day, 12), 1, "purchase", 1.0, "{}")

    schema = Tables(spark, DATA).events.schema
    parts = [
        spark.createDataFrame([event(1, 1), event(2, 10)], schema).coalesce(1),
        spark.createDataFrame([event(3, 20)], schema).coalesce(1),
        spark.createDataFrame([event(4, 2), event(5, 30)], schema).coalesce(1),
    ]
    folder = _batches(spark, tmp_path, parts)
    # rows are late against the watermark of the batch before the last
    stream = daily.read_events(spark, folder, files_per_trigger=1)
    rows = daily.run_once(daily.summarise(stream), spark).collect()
    found = {r["day"].day: r["events"] for r in rows}
    assert found == {1: 1, 10: 1, 20: 1}
