"""Streams of frames and texts whose decisions equal those of the batch operators, in whatever order rows arrive.

Rows wait in state until the watermark has passed them, are taken in order of (timestamp_ms, path), and decided by the same
rules as in batch: runs of near-equal hashes, or first-fit clusters.  Event-time timers, one a ``SLOT_MS`` at most, do
both: one takes what is due, one lets a video go that had no frame for ``idle_ms``, with all its state.

Defined results: a row later than the watermark is dropped; a video that goes on after it was let go begins anew; rows without
a video are one video; a row without a time is dropped, as no watermark ever passes it; a frame without a hash is kept
and compared with none; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from codeframes.functions.distance import SeedIndex
from codeframes.functions.text import normalize
from codeframes.schemas import check_bounds

SLOT_MS = 1000
IDLE_MS = 600_000
#: transformWithState keeps its state in this provider's stores.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """Rows of one video in order of time once the watermark has passed them."""

    #: Columns of a waiting row, besides timestamp_ms and path.
    payload = ""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"timestamp_ms bigint, path string, {self.payload}")
        self.upto = handle.getValueState("upto", "at bigint")

    def decide(self, key, rows: list[tuple]) -> list[tuple]:
        """What rows that are due become; they come in order, each once."""
        raise NotImplementedError

    def forget(self) -> None:
        """Clear the states of the video."""
        self.waiting.clear()
        self.upto.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = self.upto.get()[0] if self.upto.exists() else None
        slots = set()
        for batch in rows:
            some = [tuple(None if pd.isna(v) else v for v in r) for r in batch.drop(columns=["video_id", "at"]).itertuples(index=False, name=None)]
            some = [(int(t), p, *rest) for t, p, *rest in some if passed is None or t > passed]
            if some:
                self.waiting.appendList([(t, p, *map(self.held, rest)) for t, p, *rest in some])
                slots |= {-(-r[0] // SLOT_MS) * SLOT_MS for r in some}
        for t in slots:
            self.handle.registerTimer(t)
            self.handle.registerTimer(t + self.idle_ms)
        return iter(())

    @staticmethod
    def held(value):
        return value

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: (r[0], r[1] is not None, r[1]))
        later = [r for r in rows if r[0] > now]
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            self.upto.update((max(due[-1][0], now),))
            made = self.decide(key, due)
            if made:
                yield pd.DataFrame(made, columns=self.columns)
        elif not later and self.upto.exists() and self.upto.get()[0] + self.idle_ms <= now:
            self.forget()


class _Runs(_Ordered):
    payload = "phash bigint"
    columns = ["video_id", "path", "timestamp_ms", "phash"]

    def __init__(self, idle_ms: int, max_distance: int):
        super().__init__(idle_ms)
        self.max_distance = max_distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "phash bigint")

    @staticmethod
    def held(value):
        return None if value is None else int(value)

    def forget(self) -> None:
        super().forget()
        self.last.clear()

    def decide(self, key, rows: list[tuple]) -> list[tuple]:
        last, kept = self.last.get()[0] if self.last.exists() else None, []
        for t, path, h in rows:
            if h is None or last is None or ((h ^ last) & 0xFFFFFFFFFFFFFFFF).bit_count() > self.max_distance:
                last = last if h is None else h
                kept.append((key[0], path, t, h))
        if last is not None:
            self.last.update((last,))
        return kept


class _Clusters(_Ordered):
    payload = "norm string"
    columns = ["video_id", "path", "timestamp_ms", "norm", "cluster_id"]

    def __init__(self, idle_ms: int, threshold: float):
        super().__init__(idle_ms)
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seeds = handle.getListState("seeds", "norm string")

    def forget(self) -> None:
        super().forget()
        self.seeds.clear()

    def decide(self, key, rows: list[tuple]) -> list[tuple]:
        index, made = SeedIndex(self.threshold), []
        for (seed,) in self.seeds.get() if self.seeds.exists() else ():
            index.add(seed)
        known = len(index.seeds)
        for t, path, norm in rows:
            found = index.first(norm)
            made.append((key[0], path, t, norm, index.add(norm) if found is None else found))
        if len(index.seeds) > known:
            self.seeds.appendList([(s,) for s in index.seeds[known:]])
        return made


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", delay)


def collapse_runs(frames: DataFrame, max_distance: int = 4, delay: str = "10 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of video_id, path, timestamp_ms, phash; the frames that the batch operator keeps, once ``delay`` has passed."""
    if max_distance < 0:
        raise ValueError(f"max_distance must not be negative, not {max_distance}")
    rows = _timed(frames.select("video_id", "path", F.col("timestamp_ms").cast("long").alias("timestamp_ms"), F.col("phash").cast("long").alias("phash")), delay)
    rows = rows.select("video_id", "timestamp_ms", "path", "phash", "at")
    return rows.groupBy("video_id").transformWithStateInPandas(_Runs(idle_ms, max_distance), "video_id string, path string, timestamp_ms bigint, phash bigint", "append", "EventTime")


def cluster(extractions: DataFrame, similarity_threshold: float = 0.85, delay: str = "10 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of video_id, path, timestamp_ms, text; each text's cluster in its video, as the batch operator numbers them."""
    check_bounds(similarity_threshold=similarity_threshold)
    rows = extractions.select("video_id", "path", F.col("timestamp_ms").cast("long").alias("timestamp_ms"), F.coalesce(normalize("text"), F.lit("")).alias("norm"))
    rows = _timed(rows, delay).select("video_id", "timestamp_ms", "path", "norm", "at")
    return rows.groupBy("video_id").transformWithStateInPandas(
        _Clusters(idle_ms, similarity_threshold), "video_id string, path string, timestamp_ms bigint, norm string, cluster_id int", "append", "EventTime"
    )
