"""Structured Streaming forms of rotation, idempotent updates, deduplication and purge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def timed(stream: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """stream with an event-time column that takes a watermark (a timestamp without zone can't)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def rotate_by_time(stream: DataFrame, width: str = "30 seconds") -> DataFrame:
    """Writes and distinct-free volume of each tumbling generation."""
    return stream.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("writes"), F.sum("cents").alias("cents")).select(F.col("window.start").alias("start"), "writes", "cents")


def dedupe(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(list(keys))


class Rotation(StatefulProcessor):
    """Generations of a store's writes: one ends after `most` writes or `seconds` after its first, whichever comes first.

    Emits store, generation, and the writes, first and last seq that a micro-batch adds to it. Writes of one store in a
    micro-batch are taken in order of seq; those of an earlier micro-batch came before. With a timer (processing time)
    a generation that gets no more writes ends as well, so that it can be promoted.
    """

    def __init__(self, most: int, seconds: float | None = None, timer: bool = False):
        self.most, self.seconds, self.timer = most, seconds, timer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", StructType([StructField("generation", LongType()), StructField("n", LongType()), StructField("since", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        generation, n, since = self.state.get() if self.state.exists() else (0, 0, 0)
        whole = pd.concat(list(rows)).sort_values("seq")
        times = whole["ts"].astype("datetime64[us]").astype("int64").to_numpy() if self.seconds else [0] * len(whole)
        out: dict[int, list[int]] = {}
        for seq, at in zip(whole["seq"].tolist(), times, strict=True):
            if n and (n >= self.most or (self.seconds and at - since >= self.seconds * 1_000_000)):
                generation, n = generation + 1, 0
            if not n:
                since = int(at)
                self._set_timer(timerValues)
            n += 1
            part = out.setdefault(generation, [0, seq, seq])
            part[0], part[2] = part[0] + 1, seq
        self.state.update((generation, n, since))
        yield pd.DataFrame([(key[0], g, *part) for g, part in out.items()], columns=["store", "generation", "writes", "first_seq", "last_seq"])

    def _set_timer(self, timerValues) -> None:
        if self.timer and self.seconds:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + self.seconds * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        generation, n, _ = self.state.get()
        if n:
            self.state.update((generation + 1, 0, 0))
        return iter(())

    def close(self) -> None:
        pass


def rotate(stream: DataFrame, most: int, seconds: float | None = None, timer: bool = False) -> DataFrame:
    """store, generation, writes, first_seq and last_seq of a stream of writes (store, seq, ts), as Rotation has them."""
    mode = "ProcessingTime" if timer else "None"
    return stream.groupBy("store").transformWithStateInPandas(Rotation(most, seconds, timer), "store long, generation long, writes long, first_seq long, last_seq long", "Append", mode)


def last_versions(stream: DataFrame) -> DataFrame:
    """file and its newest version, of a stream of (file, version): older and repeated updates change nothing (output mode update)."""
    return stream.groupBy("file").agg(F.max("version").alias("version"))


def promotion(store, stream: DataFrame, keep: int, checkpoint: str, seconds: float | None = None):
    """A query that appends each micro-batch of blocks(data) as a hot generation and promotes all but the newest `keep`.

    It ends when the source has no more (availableNow). A micro-batch that runs again finds its generation there. With
    `seconds` generations are promoted, oldest first, only until that time is over; the rest stays hot.
    """

    def step(batch: DataFrame, number: int) -> None:
        if number not in store.generations():
            store.append(batch, number)
        store.promote_oldest(keep, seconds)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
