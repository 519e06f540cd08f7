"""Readers whose recognition happens elsewhere: tables of text boxes and of model replies become readings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframes.functions import text
from codeframes.operators import layout
from codeframes.plans.pipeline import paired


@dataclass(frozen=True)
class AnnotationBackend:
    """Text boxes per image (``schemas.ANNOTATIONS``) in reading order; the confidence is the mean of the boxes'."""

    name: str
    annotations: DataFrame

    def read(self, frames: DataFrame) -> DataFrame:
        found = layout.extractions(self.annotations, self.name).select("video_id", "path", "text", "confidence", "bboxes", "backend")
        return paired(frames, found)


@dataclass(frozen=True)
class TranscriptBackend:
    """Model replies (video_id, path, content, finish_reason): the first fenced block, less sure for each [?] and when
    cut off.  A reply without content is a blank reading."""

    name: str
    replies: DataFrame

    def read(self, frames: DataFrame) -> DataFrame:
        code = text.strip_fence("content")
        found = self.replies.select("video_id", "path", code.alias("text"), text.transcript_confidence(code, "finish_reason").alias("confidence"))
        return paired(frames, found).withColumn("backend", F.lit(self.name))


def requests(images: DataFrame, prompt: str, path: str = "path", content: str = "content") -> DataFrame:
    """Request bodies for a model that reads images: the prompt and the image as a data URI; too large an image is an error."""
    part = F.struct(F.lit("image_url").alias("type"), F.struct(text.data_uri(path, content).alias("url")).alias("image_url"))
    asked = F.to_json(F.struct(F.lit(0).alias("temperature"), F.lit(prompt).alias("system"), F.array(part).alias("user")))
    return images.select(path, asked.alias("request"))
