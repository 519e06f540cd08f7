"""From videos to readings: candidate frames, their hashes, the images a reader sees, and readers of images.

    timeline = hashed(candidate_frames(spark, videos, settings, shared), images.scan(spark, shared))
    Plan(ImageBackend("reader", setup, pictures, settings.crop), settings).run(timeline)

``extract_videos`` does all of it.  Pixels are read once for the hash and once for the frames that stay."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeframes.functions import text
from codeframes.operators.frames import union_frames
from codeframes.plans.pipeline import Backend, Plan, Result, materialised
from codeframes.schemas import Box, Settings
from codeframes.sources import images
from codeframes.sources.video import register

READINGS = "video_id string, seq bigint, path string, timestamp_ms bigint, text string, confidence double, backend string"


def candidate_frames(spark: SparkSession, videos: Sequence[str], settings: Settings, folder: str) -> DataFrame:
    """Frames at a constant rate and at scene cuts on one timeline; images lie in ``folder``, which all executors see."""
    register(spark)
    source = lambda option, value: spark.read.format("video_frames").option("paths", json.dumps(list(videos))).option("out_dir", folder).option(option, value).load()
    # decoding costs: both scans are written before anything reads them
    return union_frames(materialised(source("fps", settings.fps), "frames-fps"), materialised(source("scene", settings.scene_threshold), "frames-scene"))


def plain_path(path):
    """A file's path without the scheme that scans of images put before it."""
    return F.regexp_replace(path, r"^file:/+", "/")


def with_pixels(frames: DataFrame, pictures: DataFrame) -> DataFrame:
    """``frames`` with the pixels of their images; a frame without an image is an error."""
    found = pictures.select(plain_path(F.col("path")).alias("__path"), "height", "width", "channels", "data", F.lit(True).alias("__found"))
    both = frames.join(found, plain_path(frames.path) == F.col("__path"), "left")
    missing = F.raise_error(F.concat(F.lit("no image of the frame "), F.col("path"))).cast("int")
    return both.withColumn("height", F.when(F.col("__found"), F.col("height")).otherwise(missing)).drop("__path", "__found")


def hashed(frames: DataFrame, pictures: DataFrame) -> DataFrame:
    """A timeline as ``Plan.run`` takes it."""
    seen = with_pixels(frames.select("video_id", "path", "timestamp_ms"), pictures)
    return seen.select("video_id", "path", "timestamp_ms", images.perceptual_hash("height", "width", "channels", "data").alias("phash"))


@dataclass(frozen=True)
class ImageBackend:
    """``setup() -> function(list of PNG bytes) -> [(text, confidence)]``, made once per task, over the images of frames.

    With ``crop`` the reader sees that region only."""

    name: str
    setup: Callable[[], Callable[[list[bytes]], list[tuple[str, float]]]]
    pictures: DataFrame
    crop: Box | None = None

    def read(self, frames: DataFrame) -> DataFrame:
        setup, name = self.setup, self.name

        def work(batches):
            function = setup()
            for batch in batches:
                got = function(batch["png"].tolist()) if len(batch) else []
                yield batch.drop(columns="png").assign(text=[t for t, _ in got], confidence=[float(c) for _, c in got], backend=name)

        return png_frames(frames, self.pictures, self.crop).mapInPandas(work, READINGS)


@dataclass(frozen=True)
class ModelBackend:
    """A model that reads images: ``client() -> function(request dict) -> reply dict``, made once per task.

    A reply without choices is an error; one without content is blank, and one cut off is unsure."""

    name: str
    client: Callable[[], Callable[[dict], dict]]
    pictures: DataFrame
    prompt: str
    crop: Box | None = None
    model: str = ""

    def read(self, frames: DataFrame) -> DataFrame:
        client, prompt, model = self.client, self.prompt, self.model

        def work(batches):
            import base64

            ask = client()
            for batch in batches:
                contents, reasons = [], []
                for path, png in zip(batch["path"], batch["png"], strict=True):
                    uri = "data:image/png;base64," + base64.b64encode(png).decode()
                    messages = [{"role": "system", "content": prompt}, {"role": "user", "content": [{"type": "image_url", "image_url": {"url": uri}}]}]
                    choices = ask({"model": model, "temperature": 0, "messages": messages}).get("choices")
                    if not choices:
                        raise RuntimeError(f"the model gave no choices for {path}")
                    contents.append((choices[0].get("message") or {}).get("content"))
                    reasons.append(choices[0].get("finish_reason"))
                yield batch.drop(columns="png").assign(content=contents, finish_reason=reasons)

        schema = "video_id string, seq bigint, path string, timestamp_ms bigint, content string, finish_reason string"
        # a reply costs: it is written before its text is worked on
        replies = materialised(png_frames(frames, self.pictures, self.crop).mapInPandas(work, schema), "model-replies")
        code = text.strip_fence("content")
        read = replies.withColumn("text", code).withColumn("confidence", text.transcript_confidence(F.col("text"), "finish_reason"))
        return read.withColumn("backend", F.lit(self.name)).drop("content", "finish_reason")


def png_frames(frames: DataFrame, pictures: DataFrame, crop: Box | None) -> DataFrame:
    """video_id, seq, path, timestamp_ms, png: what a reader sees of each frame."""
    seen = with_pixels(frames.select("video_id", "seq", "path", "timestamp_ms"), pictures)
    if crop is not None:
        seen = images.crop(seen, crop)
    return seen.select("video_id", "seq", "path", "timestamp_ms", images.png("height", "width", "channels", "data").alias("png"))


def extract_videos(
    spark: SparkSession, videos: Sequence[str], folder: str, make_backend: Callable[[DataFrame, Box | None], Backend], settings: Settings = Settings(), make_second: Callable[[DataFrame, Box | None], Backend] | None = None
) -> Result:
    """Scripts and provenance of ``videos``; ``make_backend(pictures, crop)`` gives the reader of their images."""
    frames = candidate_frames(spark, videos, settings, folder)
    pictures = images.scan(spark, f"{folder}/*/*")
    timeline = materialised(hashed(frames, pictures), "timeline")
    second = make_second(pictures, settings.crop) if make_second else None
    return Plan(make_backend(pictures, settings.crop), settings, second).run(timeline)
