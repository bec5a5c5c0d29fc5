"""Presence of mounted volumes from periodic snapshots, as a stream and as a batch."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from drivetrove.session import materialize, number_rows

_CHANGES = "mount_path string, event string, us bigint"


class _Presence(StatefulProcessor):
    """One mount: remembers its last heartbeat and times out when heartbeats stop."""

    def __init__(self, timeout_ms: int, first_us: int | None):
        self.timeout_ms = timeout_ms
        self.first_us = first_us  # beats up to here belong to the first poll

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for beat in sorted(row["us"] for row in rows):
            if last is not None and beat - last > self.timeout_ms * 1000:
                # the silence was long enough, its timer just had no chance to fire yet
                yield Row(mount_path=key[0], event="removed", us=last + self.timeout_ms * 1000)
                last = None
            if last is None:
                first = self.first_us is not None and beat <= self.first_us
                yield Row(mount_path=key[0], event="initial" if first else "added", us=beat)
            last = beat if last is None else max(last, beat)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield Row(mount_path=key[0], event="removed", us=expiredTimerInfo.getExpiryTimeInMs() * 1000)

    def close(self) -> None:
        pass


def presence_changes(heartbeats: DataFrame, timeout_ms: int = 2500, delay: str = "0 seconds",
                     started: datetime | None = None) -> DataFrame:
    """Stream ``initial``, ``added`` and ``removed`` events from heartbeats ``(mount_path, at)``.

    Mounts that beat within ``timeout_ms`` of ``started`` (the first poll) were there already and come as
    ``initial``. A mount is removed once event time passes its last heartbeat by ``timeout_ms``. State is one
    number per mount; it needs the RocksDB state store.
    """
    first_us = None if started is None else int(started.timestamp() * 1_000_000) + timeout_ms * 1000
    changes = (
        heartbeats.select("mount_path", "at", F.unix_micros("at").alias("us")).withWatermark("at", delay)
        .groupBy("mount_path").transformWithState(_Presence(timeout_ms, first_us), _CHANGES, "Append", "EventTime")
    )
    return changes.select("mount_path", "event", F.timestamp_micros("us").alias("at"))


def presence_batch(snapshots: DataFrame) -> DataFrame:
    """Changes between consecutive snapshots ``(poll, mount_path)``.

    The first poll gives ``initial`` rows; later ones ``added`` or ``removed`` against the poll before.
    """
    seen = materialize(snapshots.select("poll", "mount_path").distinct(), "seen")
    numbered = number_rows(seen.select("poll").distinct(), "poll")
    following = numbered.select(F.col("poll").alias("_next"), (F.col("n") - 1).alias("n"))
    dated = seen.join(numbered, "poll").join(following, "n", "left")
    mine = Window.partitionBy("mount_path").orderBy("n")
    stepped = dated.withColumns({"_before": F.lag("n").over(mine), "_after": F.lead("n").over(mine)})
    came = stepped.filter(F.col("_before").isNull() | (F.col("_before") < F.col("n") - 1)).select(
        "poll", "mount_path", F.when(F.col("n") == 1, "initial").otherwise("added").alias("event"))
    went = stepped.filter(F.col("_next").isNotNull() & (
        F.col("_after").isNull() | (F.col("_after") > F.col("n") + 1))).select(
        F.col("_next").alias("poll"), "mount_path", F.lit("removed").alias("event"))
    return came.unionByName(went)
