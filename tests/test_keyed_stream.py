"""The audit with keyed state: late images, expiry, bounded state, restart."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import changes
from tallyspark.streaming import daily
from tallyspark.streaming.keyed import KeyedAudit

SCHEMA = "id int, ts timestamp, user_id int, status string, amount decimal(18,2)"
ORDER = [("ts", "asc"), ("id", "asc")]
FIELDS = {"status": None, "amount": "0.00"}
KEEP = ["id", "user_id"]


def moment(hours):
    return None if hours is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def feed(spark, images):
    return spark.createDataFrame([(i, moment(h), u, s, None) for i, h, u, s in images], SCHEMA)


def write(spark, folder, images):
    feed(spark, images).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(feed(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def audit(spark, folder, **options):
    return KeyedAudit(spark, "user_id", ORDER, FIELDS, KEEP, folder=folder, **options)


def found(*frames):
    return sorted(tuple(r) for frame in frames for r in frame.collect())


def test_late_images_find_their_place_or_are_listed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [(1, 10, 1, "b"), (2, 10, 2, "x")],
        [(3, 5, 1, "a"), (4, 20, 1, "c")],  # the first comes late, within the delay
        [(5, 100, 1, "d"), (6, 15, 1, "b")],
        [(7, 200, 2, "y")],  # the watermark passes 100 - 24
        [(8, 7, 1, "late"), (9, 130, 1, "e"), (10, None, 1, "no time")],
        [(11, 300, 3, "z")],
    ]
    for batch in batches:
        write(spark, source, batch)
    auditor = audit(spark, out, delay="24 hours")
    auditor.run_once(stream(spark, source))
    late = [(8, 7, 1, "late"), (10, None, 1, "no time")]
    kept = [image for batch in batches for image in batch if image not in late]
    expected = changes.audit_feed(feed(spark, kept), "user_id", ORDER, FIELDS, KEEP)
    assert found(auditor.settled(), auditor.waiting()) == found(expected)
    assert found(auditor.late().select("id")) == [(8,), (10,)]
    assert [r.id for r in auditor.settled().collect() if r.id == 4] == [4]


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    images = [(i, 7 * i, i % 3, "abc"[i // 2 % 3]) for i in range(30)]
    write(spark, source, images[:12])
    first = audit(spark, out)
    first.run_once(stream(spark, source))
    before = first.settled().count()
    write(spark, source, images[12:20])
    write(spark, source, images[20:])
    second = audit(spark, out)
    second.run_once(stream(spark, source))
    expected = changes.audit_feed(feed(spark, images), "user_id", ORDER, FIELDS, KEEP)
    assert found(second.settled(), second.waiting()) == found(expected)
    assert second.settled().count() > before
    # nothing new: nothing changes
    third = audit(spark, out)
    third.run_once(stream(spark, source))
    assert found(third.settled(), third.waiting()) == found(expected)


def test_state_stays_bounded_over_fifty_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in range(50):
        # two keys that stay, and two that are seen in this batch alone
        keys = enumerate([1, 2, 100 + batch, 200 + batch])
        write(spark, source, [(batch * 4 + j, batch * 10 + j, key, "ab"[batch % 2]) for j, key in keys])
    auditor = audit(spark, out, delay="20 hours", forget_ms=40 * 3600 * 1000)
    query = auditor.run_once(stream(spark, source))
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(sizes) >= 50
    # without expiry two more keys a batch would stay
    assert max(sizes[10:]) <= max(sizes[:10]) * 2 and max(sizes) < 150
    rows = auditor.settled().where("user_id < 100 and field_changed = 'status'")
    assert rows.count() >= 2 * 44


def test_daily_summary_restarts(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

    def events(days):
        rows = [(i, dt.datetime(2024, 1, d, 12), 1, "purchase", 1.0, "{}") for i, d in enumerate(days)]
        return spark.createDataFrame(rows, schema).coalesce(1)

    source = str(tmp_path / "in")
    events([1, 1, 2, 5]).write.mode("append").parquet(source)

    def run(folder):
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return daily.run_once(daily.summarise(read), spark, folder=folder)

    folder = str(tmp_path / "out")
    first = [r.day.day for r in run(folder).collect()]
    events([3, 9]).write.mode("append").parquet(source)
    events([20]).write.mode("append").parquet(source)
    rows = {r.day.day: r.events for r in run(folder).collect()}
    assert sorted(first) == [1, 2] and rows == {1: 2, 2: 1, 3: 1, 5: 1, 9: 1}
    assert {r.day.day: r.events for r in run(folder).collect()} == rows


def test_one_key_in_order(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, [(1, 1, 1, "a"), (2, 2, 1, "b")])
    auditor = audit(spark, str(tmp_path / "out"), delay="0 seconds")
    auditor.run_once(stream(spark, source))
    assert found(auditor.settled(), auditor.waiting()) == [(2, 1, "status", "a", "b")]
    assert auditor.waiting().where(F.col("id") == 1).count() == 0


def test_images_are_tuples_with_null_first_ascending_and_last_descending():
    from pyspark.sql import types as T

    from tallyspark.streaming.keyed import Neighbours

    image = T.StructType([T.StructField(name, T.IntegerType()) for name in ("a", "b", "__ms")])
    processor = Neighbours(image, [("a", "asc"), ("b", "desc")], "__ms", None, ["b"])
    images = [(1, None, 0), (1, 5, 0), (None, 1, 0), (1, 7, 0), (None, None, 0)]
    processor._sort(images)
    assert images == [(None, 1, 0), (None, None, 0), (1, 7, 0), (1, 5, 0), (1, None, 0)]
