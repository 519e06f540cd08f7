"""The whole extraction: timeline, dedup, reading, gate, second reading, merge, script and provenance.

Reading is what costs, so each reading is written before anything filters it, and is done once per frame.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframes.operators import escalate, frames, merge
from codeframes.schemas import Settings


class Backend(Protocol):
    """Reads frames: (video_id, seq, path, timestamp_ms) -> the same with text, confidence and backend."""

    name: str

    def read(self, frames: DataFrame) -> DataFrame: ...


def paired(frames: DataFrame, readings: DataFrame) -> DataFrame:
    """Every frame with its reading by (video_id, path); a frame without one is an error, as no reader skips frames."""
    found = readings.dropDuplicates(["video_id", "path"]).withColumn("__read", F.lit(True))
    both = frames.join(found, ["video_id", "path"], "left")
    missing = F.raise_error(F.concat(F.lit("no reading of the frame "), F.col("path"))).cast("string")
    return both.withColumn("text", F.when(F.col("__read"), F.col("text")).otherwise(missing)).drop("__read")


@dataclass(frozen=True)
class TableBackend:
    """Readings that exist already, by (video_id, path)."""

    name: str
    readings: DataFrame

    def read(self, frames: DataFrame) -> DataFrame:
        return paired(frames, self.readings.select("video_id", "path", "text", "confidence")).withColumn("backend", F.lit(self.name))


@dataclass(frozen=True)
class FunctionBackend:
    """``function(paths) -> [(text, confidence)]`` in batches on the executors; ``setup`` makes it once per task."""

    name: str
    setup: object

    def read(self, frames: DataFrame) -> DataFrame:
        setup, name = self.setup, self.name

        def work(batches):
            function = setup()
            for batch in batches:
                got = function(batch["path"].tolist()) if len(batch) else []
                yield batch.assign(text=[t for t, _ in got], confidence=[float(c) for _, c in got], backend=name)

        rows = frames.select("video_id", "seq", "path", "timestamp_ms")
        return rows.mapInPandas(work, "video_id string, seq bigint, path string, timestamp_ms bigint, text string, confidence double, backend string")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Written to the session's shared folder and read back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"  # one machine, as in tests
    path = f"{base.rstrip('/')}/codeframes/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Result:
    clustered: DataFrame
    snippets: DataFrame
    scripts: DataFrame
    provenance: DataFrame
    stats: DataFrame


class Plan:
    def __init__(self, primary: Backend, settings: Settings = Settings(), second: Backend | None = None):
        self.primary, self.settings, self.second = primary, settings, second

    def run(self, timeline: DataFrame) -> Result:
        """``timeline``: video_id, path, timestamp_ms, phash."""
        s = self.settings
        ordered = frames.with_seq(timeline)
        kept = materialised(frames.collapse_runs(ordered, s.dedup_max_distance), "frames-kept")
        columns = ["video_id", "seq", "path", "timestamp_ms", "text", "confidence", "backend"]
        first = materialised(self.primary.read(kept).select(*columns), "first-reading")
        passed = escalate.gate(first, s.score_threshold)
        if self.second is not None:
            again = self.second.read(escalate.doubtful(passed, s.escalate_below).select("video_id", "seq", "path", "timestamp_ms"))
            passed = escalate.adopt(passed, materialised(again.select(*columns), "second-reading"), s.score_threshold)
        else:
            passed = passed.withColumn("escalated", F.lit(False)).withColumn("adopted", F.lit(False))
        clustered = materialised(merge.cluster(passed, s.similarity_threshold), "clustered")
        found = merge.snippets(clustered, s.low_confidence_threshold, s.conflict_margin)
        scripts = merge.scripts(found)
        return Result(clustered, found, scripts, merge.provenance(clustered, found), self._stats(timeline, kept, clustered, found, scripts))

    def _stats(self, timeline: DataFrame, kept: DataFrame, clustered: DataFrame, found: DataFrame, scripts: DataFrame) -> DataFrame:
        """Counters per video."""
        n = lambda df, name: df.groupBy("video_id").agg(F.count(F.lit(1)).alias(name))
        text = scripts.select("video_id", (F.length("script") - F.length(F.replace("script", F.lit("\n")))).cast("long").alias("output_lines"), F.length("script").cast("long").alias("output_chars"))
        passed = clustered.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames_passed_scoring"), F.count_if("escalated").alias("escalated_count"))
        rows = n(timeline, "frames_raw")
        for other in (n(kept, "frames_after_dedup"), passed, n(found, "snippets_merged"), text):
            rows = rows.join(other, "video_id", "left")
        return rows.na.fill(0)
