"""Packing over a stream: a shard's open rows are state, and rows that wait too long are closed as they are.

`rows_of` is `packing.place` with best or worst fit for items that come in over time. What a shard holds is its set of open rows, a few numbers
each. A set closes when an item finds no room in it, when all its rows are nearly full, or, with `wait`, when its first item is that old. With event time
the watermark tells age, so a repeated run closes the same rows; with processing time the clock does, which also closes rows when nothing comes in any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.operators import packing

#: What is told: an item's place, a row that closed by the rules, a row that was closed by its age.
PLACED, CLOSED, FORCED = "placed", "closed", "forced"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
TOLD = [("event", T.StringType()), ("pack_id", T.LongType()), ("segment", T.IntegerType()), ("start_off", T.IntegerType()), ("used", T.IntegerType()), ("n_segments", T.IntegerType())]


class OpenRows(StatefulProcessor):
    """The open rows of a shard: a list of (used, held), the number of the first of them, and when their time is up (0: never)."""

    def __init__(self, columns: list[str], size: str, order: tuple[str, ...], length: int, min_room: int, rows: int, most: int, best: bool, wait: int, event_time: str | None):
        self.columns, self.size, self.order, self.length, self.min_room = columns, size, order, length, min_room
        self.rows, self.most, self.best, self.wait, self.event_time = rows, most, best, wait, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "used int, held int")
        self.at = handle.getValueState("at", "base long, until long")

    def _load(self) -> tuple[int, int, list[int], list[int]]:
        if not self.at.exists():
            return 0, 0, [0] * self.rows, [0] * self.rows
        base, until = self.at.get()
        used, held = zip(*self.open.get(), strict=True)
        return base, until, list(used), list(held)

    def _told(self, event: str, pack: int, item: dict, **what: object) -> Row:
        return Row(**{**dict.fromkeys([*self.columns, *(n for n, _ in TOLD)]), **item, "event": event, "pack_id": pack, **what})

    def _closed(self, event: str, shard: object, base: int, used: list[int], held: list[int]) -> Iterator[Row]:
        yield from (self._told(event, base + i, {"shard": shard}, used=u, n_segments=h) for i, (u, h) in enumerate(zip(used, held, strict=True)) if h)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        base, until, used, held = self._load()
        before = until
        for r in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            n = r[self.size]
            if n > self.length:
                raise ValueError(f"an example of {n} tokens does not fit a row of {self.length}")
            i = packing.row_for(n, used, held, self.length, self.min_room, self.most, self.best)
            if i is None:
                yield from self._closed(CLOSED, key[0], base, used, held)
                base, until, used, held, i = base + self.rows, 0, [0] * self.rows, [0] * self.rows, 0
            if self.wait and not until:
                now = int(r[self.event_time].timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
                until = now + self.wait
            yield self._told(PLACED, base + i, {c: r[c] for c in self.columns}, segment=held[i] + 1, start_off=used[i])
            used[i], held[i] = used[i] + n, held[i] + 1
        self.at.update((base, until))
        self.open.put(list(zip(used, held, strict=True)))
        if until != before:
            if before:
                self.handle.deleteTimer(before)
            if until:
                self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        base, until, used, held = self._load()
        if until and expiredTimerInfo.getExpiryTimeInMs() >= until:
            yield from self._closed(FORCED, key[0], base, used, held)
            self.at.update((base + self.rows, 0))
            self.open.put([(0, 0)] * self.rows)

    def close(self) -> None:
        pass


def rows_of(items: DataFrame, size: str, length: int = 1024, min_room: int = packing.MIN_ROOM, order: tuple[str, ...] = ("ord",), fit: str = "best", rows: int = 1, most: int = 1 << 31, wait: int = 0, event_time: str | None = None) -> DataFrame:
    """items(shard, size, the order columns, ...) of a stream with `event` and places (placed), and the rows that closed (closed, forced: shard, pack_id,
    used, n_segments; the items' other columns are null). Items of a shard go by `order` within a micro-batch, which is held sorted, and micro-batches one
    after the other; items in order give `packing.place`'s rows however the stream is cut. A micro-batch's items come before the rows that its
    watermark closes. wait: milliseconds after which open rows are closed, by the watermark
    of `event_time` (items have one then) or, without that, the clock. The state store must be RocksDB."""
    if fit not in ("best", "worst"):
        raise ValueError("fit is best or worst")
    columns = items.columns
    if clash := {n for n, _ in TOLD} & set(columns):
        raise ValueError(f"rename {', '.join(sorted(clash))}")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in items.schema.fields), *(T.StructField(n, t) for n, t in TOLD)])
    step = OpenRows(columns, size, order, length, min_room, rows, most, fit == "best", wait, event_time)
    mode = "none" if not wait else "eventTime" if event_time else "processingTime"
    return items.groupBy("shard").transformWithState(step, schema, "append", mode)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started within have RocksDB as their state store, without the 4 MB that each store of a partition would claim on disk beforehand: a shard's
    state is a few numbers."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def peek(spark: SparkSession, checkpoint: str, length: int = 1024, min_room: int = packing.MIN_ROOM) -> DataFrame:
    """shard, max_room, min_room, ready of the open rows as a stream's checkpoint holds them; the stream goes on as it is."""
    held = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return packing.readiness(held.select(F.col("key.shard").alias("shard"), F.col("list_element.used").alias("used")), length, min_room)
