"""Run-collapse dedup over a stream of frames: the state of a video is the hash of the frame kept last.

Frames of a batch are taken in order of (timestamp_ms, path).  A frame older than one already decided would make
the outcome depend on arrival, so it is dropped; for input in order, the stream keeps what the batch operator
keeps.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def collapse_runs(frames: DataFrame, max_distance: int = 4) -> DataFrame:
    """``frames``: a stream of video_id, path, timestamp_ms, phash; returns the frames kept."""
    if max_distance < 0:
        raise ValueError(f"max_distance must not be negative, not {max_distance}")

    def step(key, batches, state: GroupState):
        last, newest = state.get if state.exists else (None, None)
        # one video's frames of one micro-batch
        for batch in [pd.concat(list(batches)).sort_values(["timestamp_ms", "path"], kind="stable")]:
            keep = []
            for h, t in zip(batch["phash"], batch["timestamp_ms"], strict=True):
                fresh = newest is None or t >= newest
                new = fresh and (last is None or ((int(h) ^ last) & 0xFFFFFFFFFFFFFFFF).bit_count() > max_distance)
                if new:
                    last = int(h)
                if fresh:
                    newest = int(t)
                keep.append(new)
            if last is not None:
                state.update((last, newest))
            yield batch[keep]

    schema = "video_id string, path string, timestamp_ms bigint, phash bigint"
    return frames.select("video_id", "path", "timestamp_ms", "phash").groupBy("video_id").applyInPandasWithState(
        step, schema, "last bigint, newest bigint", "append", GroupStateTimeout.NoTimeout
    )
