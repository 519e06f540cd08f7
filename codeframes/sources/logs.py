"""Text scans: frame times in filter logs, and labelled frames next to their transcriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pts_ms(line: Column) -> Column:
    """Milliseconds of a frame line of a showinfo log, never negative; null for other lines."""
    time = F.regexp_extract(line, r"\bpts_time:(-?[0-9.]+)", 1).try_cast("double")
    return F.when(line.contains("showinfo") & line.contains(" n:") & time.isNotNull(), F.greatest(F.lit(0), F.rint(time * 1000).cast("long")))


def showinfo_times(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.withColumn("pts_ms", pts_ms(F.col(column))).filter("pts_ms is not null")


def labelled_frames(spark: SparkSession, directory: str) -> DataFrame:
    """path, name, truth: every png with a text file of the same stem, the text right-stripped."""
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    scan = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    images = scan("*.png").select("path", stem.alias("name"))
    texts = scan("*.txt").select(stem.alias("name"), F.regexp_replace(F.decode("content", "UTF-8"), r"(?U)\s+\z", "").alias("truth"))
    return images.join(texts, "name")


def frame_files(spark: SparkSession, directory: str, glob: str = "frame_*.jpg") -> DataFrame:
    """Image files of a folder by the number that ends their stem."""
    from codeframes.operators.frames import numeric_suffix

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    return files.select("path", numeric_suffix(F.col("path")).alias("number"), "length")
