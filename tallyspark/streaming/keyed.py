"""Change audit with keyed state: each key's images in event-time order, state of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyspark.operators.changes import change_entries
from tallyspark.operators.ranking import Order, sort_columns
from tallyspark.session import fresh_path

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _compare(order: Sequence[tuple[int, str]], a: Sequence, b: Sequence) -> int:
    """NULL sorts first ascending and last descending, as everywhere in this library."""
    for at, way in order:
        x, y = a[at], b[at]
        if x != y:
            below = y is not None and (x is None or x < y)
            return (-1 if below else 1) * (1 if way == "asc" else -1)
    return 0


class Neighbours(StatefulProcessor):
    """Pairs each image of a key with the one before it, once the watermark has passed its time.

    State holds the images whose time the watermark has not passed, and the
    last image that was paired. An image that arrives late finds its place as
    long as it sorts behind that one; otherwise it goes out with ``late`` set,
    as does an image without time. With ``forget_ms`` a key is forgotten when
    the watermark is so far past its last image; what comes then is its first.
    """

    def __init__(self, image: T.StructType, order: Order, clock: str, forget_ms: int | None, old: Sequence[str]):
        self.image, self.forget_ms = image, forget_ms
        self.names = image.names
        # images are plain tuples here: a row by name costs several times as much
        self.clock = self.names.index(clock)
        self.order = [(self.names.index(name), way) for name, way in order]
        self.old = [self.names.index(name) for name in old]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.image)
        self.last = handle.getValueState("last", self.image)
        self.output = Row("late", "new", "old")

    def _sort(self, images: list[tuple]) -> None:
        """NULL sorts first ascending and last descending, as everywhere in this library."""
        for at, way in reversed(self.order):
            images.sort(key=lambda image: (image[at] is not None, image[at]), reverse=way == "desc")

    def _pair(self, image: tuple, last: tuple) -> Row:
        return self.output(False, image, tuple([last[at] for at in self.old]))

    def _wake(self, moment: int, firing: int | None = None) -> None:
        """Keep one timer, at the earliest moment asked for; the one that is firing is still listed."""
        timers = [timer for timer in self.handle.listTimers() if timer != firing]
        if not timers or moment < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(moment)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, clock = self.last.get(), self.clock
        kept, earliest = [], None
        for row in rows:
            image = tuple([row[name] for name in self.names]) if list(row.__fields__) != self.names else tuple(row)
            moment = image[clock]
            if moment is None or (last is not None and _compare(self.order, image, last) < 0):
                yield self.output(True, image, None)
                continue
            kept.append(image)
            earliest = moment if earliest is None else min(earliest, moment)
            if len(kept) >= 1000:
                self.waiting.appendList(kept)
                kept = []
        if kept:
            self.waiting.appendList(kept)
        if earliest is not None:
            self._wake(earliest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark, firing = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        due, early, clock = [], [], self.clock
        for values in self.waiting.get():
            image = tuple(values)
            (due if image[clock] <= mark else early).append(image)
        last = self.last.get()
        last = None if last is None else tuple(last)
        self._sort(due)
        for image in due:
            if last is not None:
                yield self._pair(image, last)
            last = image
        if due:
            self.last.update(last)
            if early:
                self.waiting.put(early)
            else:
                self.waiting.clear()
        if early:
            self._wake(min(image[clock] for image in early), firing)
        elif last is not None and self.forget_ms is not None:
            if last[clock] + self.forget_ms <= mark:
                self.last.clear()
            else:
                self._wake(last[clock] + self.forget_ms, firing)

    def close(self) -> None:
        pass


class KeyedAudit:
    """Audits a stream of row images against the previous image of their key.

    ``clock`` is the event-time column, which ``order`` starts with; ``delay``
    is how far behind the greatest time an image may arrive. Audit rows are
    appended once an image's predecessor is certain. Images that come too late
    for that are appended to ``late()``. ``folder`` holds output and progress: a
    new object over the same folder goes on where the last one stopped, and a
    batch that is run again replaces its own output.

    A key's images that wait for the watermark are sorted in one task; their
    number is bounded by what arrives of a key within ``delay``.
    """

    def __init__(
        self,
        spark: SparkSession,
        key: str,
        order: Order,
        fields: dict[str, str | None],
        keep: Sequence[str],
        delay: str = "2 days",
        forget_ms: int | None = None,
        folder: str | None = None,
    ):
        self.spark, self.key, self.order = spark, key, list(order)
        self.fields, self.keep, self.delay, self.forget_ms = fields, list(keep), delay, forget_ms
        self.folder = folder or fresh_path(spark, "keyed-audit")
        self.clock = order[0][0]
        #: Of the written rows, once a stream has been started.
        self.schema: T.StructType | None = None
        self.columns = list(dict.fromkeys([key, *[name for name, _ in order], *keep, *fields]))

    def pairs(self, stream: DataFrame) -> DataFrame:
        """Rows of (late, new, old): images with the audited fields of their predecessors."""
        marked = stream.withColumn("__time", F.col(self.clock).cast("timestamp")).withWatermark("__time", self.delay)
        # milliseconds as a plain number: rows behind the watermark then reach the state, too
        moment = F.unix_millis("__time").alias("__ms")
        images = marked.select(*self.columns, moment)
        image = images.schema
        output = T.StructType(
            [
                T.StructField("late", T.BooleanType()),
                T.StructField("new", image),
                T.StructField("old", T.StructType([image[name] for name in self.fields])),
            ]
        )
        processor = Neighbours(image, [("__ms", self.order[0][1]), *self.order], "__ms", self.forget_ms, list(self.fields))
        return images.groupBy(self.key).transformWithState(processor, output, "Append", "EventTime")

    def rows(self, stream: DataFrame) -> DataFrame:
        """Audit rows, and one row with a null field for each late image."""
        entries = change_entries(self.fields)
        nothing = F.array(F.lit(None).cast("struct<field_changed:string,old_value:string,new_value:string>"))
        chosen = F.when(F.col("late"), nothing).otherwise(
            F.transform(
                F.filter(entries, lambda e: e["changed"]),
                lambda e: F.struct(e["field_changed"], e["old_value"], e["new_value"]),
            )
        )
        return self.pairs(stream).select("late", F.col("new").dropFields("__ms").alias("image"), F.explode(chosen).alias("c")).select(
            "late", "image", "c.field_changed", "c.old_value", "c.new_value"
        )

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        before = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, _ROCKS)
        rows = self.rows(stream)
        self.schema = rows.schema
        try:
            return (
                rows.writeStream.format("parquet")
                .outputMode("append")
                .partitionBy("late")
                .option("path", f"{self.folder}/rows")
                .option("checkpointLocation", f"{self.folder}/progress")
                .trigger(**trigger)
                .start()
            )
        finally:
            if before is None:
                self.spark.conf.unset(_PROVIDER)
            else:
                self.spark.conf.set(_PROVIDER, before)

    def run_once(self, stream: DataFrame) -> StreamingQuery:
        """Process what is there."""
        query = self.start(stream, availableNow=True)
        query.awaitTermination()
        return query

    def _written(self) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.folder}/rows")

    def settled(self) -> DataFrame:
        """Audit rows of the images that the watermark has passed."""
        keep = [F.col(f"image.{name}").alias(name) for name in self.keep]
        return self._written().where("not late").select(*keep, "field_changed", "old_value", "new_value")

    def late(self) -> DataFrame:
        """Images that came when a later image of their key had been audited already."""
        return self._written().where("late").select("image.*")

    def _state(self, variable: str, value: str) -> DataFrame:
        state = self.spark.read.format("statestore").option("stateVarName", variable)
        return state.load(f"{self.folder}/progress").select(f"{value}.*")

    def waiting(self) -> DataFrame:
        """Audit rows of the images in state, as they stand: later arrivals may still come between."""
        images = self._state("waiting", "list_element").withColumn("__waits", F.lit(True))
        images = images.unionByName(self._state("last", "value").withColumn("__waits", F.lit(False)))
        # one key's images in state are bounded, see the class
        order = Window.partitionBy(self.key).orderBy(*sort_columns(self.order))
        image = F.struct(*self.columns)
        paired = images.select("__waits", image.alias("new"), F.lag(image).over(order).alias("old"))
        keep = [F.col(f"new.{name}").alias(name) for name in self.keep]
        found = F.filter(change_entries(self.fields), lambda e: e["changed"])
        return (
            paired.where("__waits and old is not null")
            .select(*keep, F.explode(found).alias("c"))
            .select(*self.keep, "c.field_changed", "c.old_value", "c.new_value")
        )
