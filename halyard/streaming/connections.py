"""Connections that close when they are idle: counts of transfers in flight and one timer for each connection, as state of a stream.

Rows are (connection, kind, instance, at): ``start`` and ``end`` of an instance's transfer, and ``abort``. A start disarms the timer; an end arms it anew, so that
the delay counts from the last activity. A timer that fires while transfers are open is armed again; else the connection closes and its state goes.
An abort closes at once, whatever is open. An instance may be in flight several times; its count is gone at zero, and an end without a start only arms the timer.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CLOSED = "connection string, opened timestamp, closed timestamp, transfers long, in_flight long, reason string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NONE = -1


def _moment(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


class IdleClose(StatefulProcessor):
    """``event_time``: the delay counts by the rows' times, so that results don't depend on how rows are batched; else by the clock."""

    def __init__(self, delay_ms: int, event_time: bool):
        self.delay, self.event_time = delay_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flying = handle.getMapState("flying", "instance string", "n int")
        self.line = handle.getValueState("line", "opened long, transfers long, fires long")

    def _arm(self, before: int, at: int) -> None:
        if before != at:
            if before != _NONE:
                self.handle.deleteTimer(before)
            if at != _NONE:
                self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """A connection's state is read once and written once for all its rows of a batch; in between it is held here."""
        now = timerValues.getCurrentProcessingTimeInMs()
        kept = self.line.get()
        opened, transfers, armed = kept or (_NONE, 0, _NONE)
        before = {instance: n for (instance,), (n,) in self.flying.iterator()} if kept else {}
        flying, fires, in_flight = dict(before), armed, sum(before.values())

        def closed(at: int, reason: str) -> Row:
            return Row(connection=key[0], opened=_moment(opened), closed=_moment(at), transfers=transfers, in_flight=in_flight, reason=reason)

        order = {"start": 0, "end": 1, "abort": 2}
        for row in sorted(rows, key=lambda r: (r["at"], order[r["kind"]])):
            at = int(row["at"].timestamp() * 1000) if self.event_time else now
            while fires != _NONE and self.event_time and at >= fires:  # the timer of before this row
                if in_flight:
                    fires += self.delay * ((at - fires) // self.delay + 1)
                    continue
                yield closed(fires, "idle")
                opened, transfers, fires, in_flight = _NONE, 0, _NONE, 0
                flying.clear()
            if opened == _NONE:
                if row["kind"] == "abort":
                    continue
                opened = at
            if row["kind"] == "abort":
                yield closed(at, "aborted")
                opened, transfers, fires, in_flight = _NONE, 0, _NONE, 0
                flying.clear()
                continue
            instance = row["instance"]
            count = flying.get(instance, 0)
            if row["kind"] == "start":
                flying[instance] = count + 1
                in_flight += 1
                transfers += 1
                fires = _NONE
            else:
                if count:
                    in_flight -= 1
                    flying[instance] = count - 1
                    if count == 1:
                        del flying[instance]
                fires = at + self.delay
        self._arm(armed, fires)
        if before and not flying:
            self.flying.clear()
        else:
            for instance in before.keys() - flying.keys():
                self.flying.removeKey((instance,))
            for instance, n in flying.items():
                if before.get(instance) != n:
                    self.flying.updateValue((instance,), (n,))
        if opened != _NONE:
            self.line.update((opened, transfers, fires))
        elif kept:
            self.line.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        kept = self.line.get()
        if not kept:
            return
        opened, transfers, fires = kept
        if fires != at:
            return
        if sum(1 for _ in self.flying.keys()):
            upto = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            again = at + self.delay * max(1, (upto - at) // self.delay + 1)
            self.handle.registerTimer(again)
            self.line.update((opened, transfers, again))
            return
        self.line.clear()
        yield Row(connection=key[0], opened=_moment(opened), closed=_moment(at), transfers=transfers, in_flight=0, reason="idle")

    def close(self) -> None:
        pass


def idle_close(stream: DataFrame, delay_ms: int, late: str | None = None) -> DataFrame:
    """Rows of ``CLOSED``, one for each connection that closes. With ``late``, by the rows' times under a watermark; else by the clock.

    A row at or behind the watermark is late and left out, so ``late`` should be longer than what may come apart. The state is kept in RocksDB: start the stream
    inside ``state_in_rocksdb``.
    """
    rows = stream.withWatermark("at", late) if late else stream
    mode = "EventTime" if late else "ProcessingTime"
    return rows.groupBy("connection").transformWithState(IdleClose(delay_ms, late is not None), CLOSED, "Append", mode)


@contextlib.contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which timers and several state variables need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
