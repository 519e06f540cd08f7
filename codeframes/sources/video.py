"""Frames of video files through ffmpeg as a Spark data source, one partition per video; by batch and by stream.

    register(spark)
    spark.read.format("video_frames").option("paths", json.dumps(videos)).option("fps", 1).option("out_dir", shared).load()
    spark.readStream.format("video_frames").option("folder", inbox).option("log_dir", log).option("out_dir", shared).load()

``paths`` is a JSON list, or names with commas between; ``scene`` instead of ``fps`` takes scene cuts; ``ffmpeg`` names the
program.  ``out_dir`` must be a folder that all executors see.  Every attempt to decode a video writes a folder of its own, and
its rows name that folder: a retried or speculative task neither deletes nor mixes another's pictures, and what an
attempt that failed has left there is never read.

Filters on ``video_id`` leave videos out before anything is decoded; an upper bound of ``timestamp_ms`` ends decoding soon
after it; both bounds hold exactly, as rows beyond them are left out.

A stream takes each file of ``folder`` once, whatever its time, in the order of names among files that appear together; names
that begin with ``_`` or ``.`` are passed over, so that a file can be moved in when it is whole.  What was seen is written to
``log_dir`` before an offset counts it, and an offset is a number of files in that log: after a restart the same offsets mean
the same files, none lost and none repeated.
"""

from __future__ import annotations

import hashlib
import json
import shutil
import subprocess
import uuid
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from codeframes.schemas import FRAMES


class MissingTool(RuntimeError):
    """ffmpeg isn't on the path."""


def require(tool: str = "ffmpeg") -> str:
    found = shutil.which(tool)
    if not found:
        raise MissingTool(f"{tool} is not installed or not on the path")
    return found


def times_of(log: str) -> list[int]:
    """Milliseconds of the frame lines of a showinfo log."""
    import re

    found = []
    for line in log.splitlines():
        m = re.search(r"\bpts_time:(-?[0-9.]+)", line)
        if "showinfo" in line and " n:" in line and m:
            found.append(max(0, round(float(m[1]) * 1000)))
    return found


def video_filter(fps: float | None, scene: float | None) -> str:
    if scene is not None:
        if not 0 < scene <= 1:
            raise ValueError(f"scene must be above 0 and at most 1, not {scene}")
        return f"select='gt(scene,{scene})',showinfo"
    if not (fps and fps > 0):
        raise ValueError(f"fps must be positive, not {fps}")
    return f"fps={fps},showinfo"


def decode(path: str, out_dir: str, fps: float | None, scene: float | None, until_ms: int | None = None, program: str = "ffmpeg") -> list[tuple[str, str, int]]:
    """Decode one video into a fresh folder: (video, image, milliseconds), up to about ``until_ms`` where that is given."""
    chain, tool = video_filter(fps, scene), require(program)
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    kind = "scene" if scene is not None else "frame"
    folder = Path(out_dir) / f"{Path(path).stem}_{hashlib.sha256(path.encode()).hexdigest()[:8]}" / f"{kind}-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    # a second and a frame more than asked for, so that the end changes no frame before it
    end = [] if until_ms is None else ["-t", f"{max(until_ms, 0) / 1000 + 1 + (1 / fps if scene is None else 0):.3f}"]
    command = [tool, "-hide_banner", *end, "-i", path, "-vf", chain, "-vsync", "vfr", str(folder / f"{kind}_%06d.jpg")]
    run = subprocess.run(command, capture_output=True, text=True, check=True)
    images = sorted(folder.glob(f"{kind}_*.jpg"), key=lambda p: int(p.stem.rsplit("_", 1)[1]))
    times = times_of(run.stderr)
    if len(images) != len(times):
        raise RuntimeError(f"{len(images)} images but {len(times)} times in {path}")
    return [(path, str(i), t) for i, t in zip(images, times, strict=True)]


class _Video(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Decoder:
    """What batch and stream share: the options, and the frames of a partition."""

    def __init__(self, options):
        self.out_dir, self.program = options.get("out_dir"), options.get("ffmpeg", "ffmpeg")
        number = lambda key: float(options[key]) if key in options else None
        self.scene, self.fps = number("scene"), number("fps")
        if self.scene is None and self.fps is None:
            self.fps = 1.0
        if not self.out_dir:
            raise ValueError("out_dir is needed, a folder that all executors see")
        video_filter(self.fps, self.scene)
        self.low, self.high = None, None

    def read(self, partition):
        if partition is None:  # Spark's one task for a source that has no partitions
            return
        for video, image, time in decode(partition.path, self.out_dir, self.fps, self.scene, self.high, self.program):
            if (self.low is None or time >= self.low) and (self.high is None or time <= self.high):
                yield video, image, time


class _Reader(_Decoder, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        listed = options.get("paths", "")
        self.paths = json.loads(listed) if listed.lstrip().startswith("[") else [p for p in listed.split(",") if p]

    def partitions(self):
        return [_Video(p) for p in self.paths]


class _PrunedReader(_Reader):
    def pushFilters(self, filters):
        """Take filters on the video and bounds of the time; yield the others, which Spark applies."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("video_id",) and isinstance(f, (EqualTo, In)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.paths = [p for p in self.paths if p in wanted]
            elif column == ("timestamp_ms",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = f.value + 1 if isinstance(f, GreaterThan) else None if isinstance(f, (LessThan, LessThanOrEqual)) else f.value
                high = f.value - 1 if isinstance(f, LessThan) else None if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else f.value
                self.low = max((x for x in (self.low, low) if x is not None), default=None)
                self.high = min((x for x in (self.high, high) if x is not None), default=None)
            else:
                yield f


class _StreamReader(_Decoder, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.folder, self.log_dir = options.get("folder"), options.get("log_dir")
        if not (self.folder and self.log_dir):
            raise ValueError("a stream needs folder, which gets the videos, and log_dir, which keeps what was seen")
        self.seen: list[str] = []

    def _catch_up(self) -> None:
        """Read the parts of the log that this reader doesn't hold yet; a part is named by the number of its first file."""
        log = Path(self.log_dir)
        while (part := log / f"{len(self.seen):012d}.json").is_file():
            self.seen += json.loads(part.read_text())

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        self._catch_up()
        known = set(self.seen)
        new = sorted(str(p) for p in Path(self.folder).iterdir() if p.is_file() and p.name[0] not in "._" and str(p) not in known)
        if new:
            log = Path(self.log_dir)
            log.mkdir(parents=True, exist_ok=True)
            draft = log / f".{uuid.uuid4().hex}"
            draft.write_text(json.dumps(new))
            draft.rename(log / f"{len(self.seen):012d}.json")
            self.seen += new
        return {"files": len(self.seen)}

    def partitions(self, start, end):
        self._catch_up()
        if len(self.seen) < end["files"]:
            raise ValueError(f"{self.log_dir} holds {len(self.seen)} files, but the offset counts {end['files']}")
        return [_Video(p) for p in self.seen[start["files"] : end["files"]]]

    def commit(self, end):
        """Nothing goes: the log tells seen files from new ones."""


class FrameSource(DataSource):
    @classmethod
    def name(cls):
        return "video_frames"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


class PrunedFrameSource(FrameSource):
    """The same frames, with filters that reach the source; the session must allow that, as ``register`` has it do."""

    def reader(self, schema):
        return _PrunedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``video_frames`` known to the session, with filters that reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PrunedFrameSource)
