"""Images as rows: scan, crop, perceptual hash and PNG bytes.  Pixels are the one place where Python works per row."""

from __future__ import annotations

import functools
import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from codeframes.schemas import Box

SIDE, LOW = 32, 8


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels and data (blue, green, red) of the images below a path."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def grey(image: np.ndarray) -> np.ndarray:
    if image.shape[2] == 1:
        return image[:, :, 0].astype(float)
    return image[:, :, :3].astype(float) @ np.array([0.114, 0.587, 0.299])


def shrink(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Area average along sides that are longer."""
    for axis in (0, 1):
        n = image.shape[axis]
        if n > side:
            edges = np.arange(side) * n // side
            counts = np.diff(np.append(edges, n))
            image = np.add.reduceat(image, edges, axis=axis) / (counts[:, None] if axis == 0 else counts[None, :])
    return image


@functools.cache
def waves(n: int) -> np.ndarray:
    """The cosines of each frequency at ``n`` pixels, each of which stands for its nearest places among ``SIDE``."""
    made = np.zeros((LOW, n))
    for x in range(SIDE):
        made[:, x * n // SIDE] += [math.cos(math.pi * (2 * x + 1) * k / (2 * SIDE)) for k in range(LOW)]
    return made


def transformed(image: np.ndarray) -> np.ndarray:
    """``waves @ image`` with every sum added up in the order of the rows.

    Two frequencies can be equal but for rounding, and at the median rounding decides their bits: a matrix product adds
    in another order on another machine, this one as the SQL does on one thread."""
    return np.add.accumulate(waves(len(image)).T[:, :, None] * image[:, None, :])[-1]


def hash_of(image: np.ndarray) -> int:
    """64 bits: the low frequencies of a cosine transform that lie above their median."""
    low = transformed(transformed(shrink(grey(image))).T).T.ravel()
    value = int.from_bytes(np.packbits(low > np.median(low)).tobytes(), "big")
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(LongType())
def perceptual_hash(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([hash_of(pixels(h, w, c, d)) for h, w, c, d in zip(height, width, channels, data, strict=True)], dtype="int64")


def inside(box: Box, height: Column, width: Column) -> Column:
    """The box's check as a column: true, or an error."""
    ok = F.lit(box.width > 0 and box.height > 0 and box.x >= 0 and box.y >= 0) & (F.lit(box.x + box.width) <= width) & (F.lit(box.y + box.height) <= height)
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("the crop is empty or beyond the image")).cast("boolean"))


def crop(images: DataFrame, box: Box) -> DataFrame:
    """The same rows with the region's pixels; an empty region or one beyond the image is an error."""

    @F.pandas_udf(BinaryType())
    def cut(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        rows = zip(height, width, channels, data, strict=True)
        return pd.Series([pixels(h, w, c, d)[box.y : box.y + box.height, box.x : box.x + box.width].tobytes() for h, w, c, d in rows])

    checked = images.filter(inside(box, F.col("height"), F.col("width")))
    made = checked.withColumn("data", cut("height", "width", "channels", "data"))
    return made.withColumn("height", F.lit(box.height)).withColumn("width", F.lit(box.width))


def crop_name(path: Column, timestamp_ms: Column, box_x: Column, box_y: Column, width: Column, height: Column) -> Column:
    """A file name that differs for each image, time and region."""
    from codeframes.functions.text import artifact_base

    return F.concat(F.concat_ws("_", artifact_base(path), timestamp_ms, F.left(F.sha2(path, 256), F.lit(8)), box_x, box_y, width, height), F.lit(".png"))


def png_bytes(image: np.ndarray) -> bytes:
    """A PNG file of grey or blue-green-red pixels."""
    h, w, c = image.shape
    rows = image[:, :, [2, 1, 0]] if c >= 3 else image[:, :, :1]
    raw = b"".join(b"\x00" + r.tobytes() for r in np.ascontiguousarray(rows))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c >= 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@F.pandas_udf(BinaryType())
def png(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([png_bytes(pixels(h, w, c, d)) for h, w, c, d in zip(height, width, channels, data, strict=True)])


def crop_files(images: DataFrame, box: Box) -> DataFrame:
    """name, content: the cropped region of each image (path, timestamp_ms and pixels) as a PNG file."""
    sides = [F.lit(v) for v in (box.x, box.y, box.width, box.height)]
    cut = crop(images, box)
    return cut.select(crop_name(F.col("path"), F.col("timestamp_ms"), *sides).alias("name"), png("height", "width", "channels", "data").alias("content"))


def write_crops(images: DataFrame, box: Box, folder: str) -> DataFrame:
    """name, size: writes each image's region as a PNG file into ``folder``, which all executors see."""

    def work(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"name": batch["name"], "size": batch["content"].map(len)})

    return crop_files(images, box).mapInPandas(work, "name string, size long")
