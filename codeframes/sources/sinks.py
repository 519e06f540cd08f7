"""Writers of scripts and provenance, one file per video, and the summary of a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_scripts(scripts: DataFrame, path: str) -> None:
    """``video_id=.../part-*``: each video's script as one text value; a new run replaces the videos that it holds."""
    value = F.regexp_replace("script", r"\n\z", "")  # the writer ends the line itself
    scripts.select(value.alias("value"), "video_id").repartition("video_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").text(path)


def provenance_json(entries: DataFrame) -> DataFrame:
    """video_id, document: all entries of a video as a pretty JSON array that ends in a newline."""
    rows = entries.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("entry", "timestamp", "screenshot", "raw_ocr", "cleaned_code"))).alias("rows"))

    def pretty(batches):
        for batch in batches:
            documents = []
            for found in batch["rows"]:
                keep = [{k: (int(r[k]) if k == "timestamp" else r[k]) for k in ("timestamp", "screenshot", "raw_ocr", "cleaned_code")} for r in found]
                documents.append(json.dumps(keep, indent=2, ensure_ascii=False) + "\n")
            yield batch[["video_id"]].assign(document=documents)

    return rows.mapInPandas(pretty, "video_id string, document string")


def write_provenance(entries: DataFrame, path: str) -> None:
    """JSON lines below ``video_id=...``, a line per entry in order; a new run replaces the videos that it holds."""
    ordered = entries.repartition("video_id").sortWithinPartitions("video_id", "entry")
    ordered.select("video_id", "timestamp", "screenshot", "raw_ocr", "cleaned_code").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").json(path)


def summary(stats: dict) -> str:
    """The counts of a run as text; shares are 0 where there is nothing to share."""
    raw, kept, passed = stats["frames_raw"], stats["frames_after_dedup"], stats["frames_passed_scoring"]
    minutes, seconds = divmod(int(stats.get("total_time", 0)), 60)
    removed = round((1 - kept / raw) * 100) if raw else 0
    share = round(passed / kept * 100) if kept else 0
    lines = [
        ("Frames extracted", f"{raw:>8,}"), ("After dedup", f"{kept:>8,}  ({removed}% removed)"), ("Passed scoring gate", f"{passed:>8,}  ({share}%)"),
        ("Escalated", f"{stats['escalated_count']:>8,}"), ("Snippets merged", f"{stats['snippets_merged']:>8,}"),
        ("Output", f"lines: {stats['output_lines']:,}   chars: {stats['output_chars']:,}"), ("Time", f"{minutes}m {seconds:02d}s" if minutes else f"{seconds}s"),
    ]
    return "\n".join(f"  {name + ':':<21}{value}" for name, value in lines)
