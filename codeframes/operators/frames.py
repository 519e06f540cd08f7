"""Timelines of frames: ordering, union, pairing and the collapse of runs of near-equal frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_seq(frames: DataFrame) -> DataFrame:
    """A dense ``seq`` from 0 by (timestamp_ms, path) in each video."""
    order = Window.partitionBy("video_id").orderBy("timestamp_ms", "path")
    return frames.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


def union_frames(sampled: DataFrame, scene_cuts: DataFrame) -> DataFrame:
    """Both scans on one timeline; frames that both have stay twice."""
    return with_seq(sampled.unionByName(scene_cuts))


def sample_fps(frames: DataFrame, fps: float) -> DataFrame:
    """One frame per 1/fps slot, the first one: the relational shape of a constant-rate scan."""
    if not fps > 0:
        raise ValueError(f"fps must be positive, not {fps}")
    slot = F.floor(F.col("timestamp_ms") * fps / 1000)
    firsts = frames.groupBy("video_id", slot.alias("__slot")).agg(F.min_by(F.struct(*frames.columns), F.struct("timestamp_ms", "path")).alias("__row"))
    return firsts.select("__row.*")


def scene_cuts(frames: DataFrame, threshold: float, score: str = "scene_score") -> DataFrame:
    """Frames whose scene score is above the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError(f"the scene threshold must be above 0 and at most 1, not {threshold}")
    return frames.filter(F.col(score) > threshold)


def pair_by_ordinal(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column], strict: bool = True) -> DataFrame:
    """The n-th row of either side per key; a count that differs is an error where ``strict``."""
    n = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    a, b = left.withColumn("ordinal", n(left_order)).withColumn("__l", F.lit(1)), right.withColumn("ordinal", n(right_order)).withColumn("__r", F.lit(1))
    both = a.join(b, [*keys, "ordinal"], "full_outer")
    if strict:
        alone = F.col("__l").isNull() | F.col("__r").isNull()
        both = both.withColumn("ordinal", F.when(alone, F.raise_error(F.lit("frames and timestamps differ in number")).cast("int")).otherwise(F.col("ordinal")))
    return both.drop("__l", "__r")


def numeric_suffix(path: Column) -> Column:
    """The number after the last underscore of a file's stem."""
    return F.regexp_extract(path, r"_(\d+)(?:\.[^./]*)?$", 1).try_cast("int")


def collapse_runs(frames: DataFrame, max_distance: int = 4, hash_column: str = "phash") -> DataFrame:
    """Keep a frame if its hash is more than ``max_distance`` bits from that of the frame kept last in its video.

    Each video's rows pass through one task in order of ``seq``; a task holds one hash per running video and no
    rows, so a long video costs time but no memory.  A frame without a hash is kept and compared with none."""
    if max_distance < 0:
        raise ValueError(f"max_distance must not be negative, not {max_distance}")
    columns = frames.columns

    def fold(batches):
        video, last = object(), None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (v, h) in enumerate(zip(batch.column("video_id").to_pylist(), batch.column(hash_column).to_pylist(), strict=True)):
                if v != video:
                    video, last = v, None
                if h is None:
                    keep[i] = True
                elif last is None or ((h ^ last) & 0xFFFFFFFFFFFFFFFF).bit_count() > max_distance:
                    last, keep[i] = h, True
            yield batch.filter(pa.array(keep))

    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = frames.repartition(n, "video_id").sortWithinPartitions("video_id", "seq")
    return ordered.mapInArrow(fold, frames.schema).select(*columns)
