"""Playlists of recordings: the segments' places in time, and which segment an elapsed time falls into.

The match is a merge of two sides sorted by time, cut into buckets of time so that no playlist, however long or often
reported on, is sorted in one task; a bucket begins with a row that has the segment which the buckets before it left, and the
playlist's length.  ``tasks_for`` gives so many tasks that each holds about ``ROWS_EACH`` rows, however many there are.

Defined results: a segment without a readable duration takes no time; a blank line and comments are no segments; a time before the
first segment or without one has none, as has a null time; rows without a playlist belong together; reports that repeat
are located one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DURATION = "#EXTINF:"
BUCKET_MS = 600_000
ROWS_EACH = 1 << 18


def tasks_for(rows: DataFrame) -> int:
    """Tasks for playlists of that many rows: the session's shuffle partitions, more if these would hold over ``ROWS_EACH`` each."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_EACH))


def segments(lines: DataFrame) -> DataFrame:
    """(playlist, number, uri, start_ms, duration_ms) from the lines (playlist, line_no, line) of playlists.

    A segment's line is the address; its duration stands on the last duration line before it that follows the segment before."""
    text = F.trim("line")
    tag = F.when(text.startswith(DURATION), F.coalesce(F.round(F.substring_index(F.substring(text, len(DURATION) + 1, 64), ",", 1).try_cast("double") * 1000).cast("long"), F.lit(0)))
    order = Window.partitionBy("playlist").orderBy("line_no")
    marked = lines.select("playlist", "line_no", text.alias("uri"), tag.alias("tag"), ((text != "") & ~text.startswith("#")).cast("long").alias("is_segment"))
    numbered = marked.filter((F.col("is_segment") == 1) | F.col("tag").isNotNull()).withColumn("number", F.coalesce(F.sum("is_segment").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = numbered.groupBy("playlist", "number").agg(
        F.max("uri").alias("__any"), F.max(F.when(F.col("is_segment") == 1, F.col("uri"))).alias("uri"),
        F.max_by(F.col("tag"), F.when(F.col("tag").isNotNull(), F.col("line_no"))).alias("tag"),
    ).filter(F.col("uri").isNotNull())
    timed = whole.withColumn("duration_ms", F.coalesce("tag", F.lit(0)))
    before = Window.partitionBy("playlist").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return timed.select("playlist", "number", "uri", F.coalesce(F.sum("duration_ms").over(before), F.lit(0)).alias("start_ms"), "duration_ms")


def located(reports: DataFrame, found: DataFrame, bucket_ms: int = BUCKET_MS, tasks: int | None = None) -> DataFrame:
    """``reports`` (playlist, elapsed_ms, ...) with number, uri and start_ms of the last segment that began by then, and ``percent``
    of the playlist's length; in that many tasks, by default the session's shuffle partitions."""
    from codeframes.functions.text import percent_done

    bucket = lambda ms: F.floor(F.col(ms) / bucket_ms)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
    place = "struct<start_ms: bigint, number: bigint, uri: string>"
    segment = F.struct(F.col("start_ms").alias("start_ms"), F.col("number").alias("number"), F.col("uri").alias("uri"))
    ours = found.select("playlist", bucket("start_ms").alias("b"), F.col("start_ms").alias("t"), F.lit(1).alias("side"), "number", segment.alias("segment"), F.col("duration_ms").alias("ms"), none(_row_type(reports), "row"))
    theirs = reports.select("playlist", bucket("elapsed_ms").alias("b"), F.col("elapsed_ms").alias("t"), F.lit(2).alias("side"), none("long", "number"), none(place, "segment"), none("long", "ms"), F.struct(*reports.columns).alias("row"))
    both = ours.unionByName(theirs)
    # the segment that each bucket starts with and the playlist's length, as a row before all others of the bucket
    last = dealt(both.select("playlist", "b", "segment", "ms"), "playlist", "b").groupBy("playlist", "b").agg(F.max("segment").alias("latest"), F.sum("ms").alias("ms"))
    own = Window.partitionBy("playlist")
    carried = F.last("latest", True).over(own.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    heads = dealt(last, "playlist").select("playlist", "b", none("long", "t"), F.lit(0).alias("side"), none("long", "number"), carried.alias("segment"), F.sum("ms").over(own).alias("ms"), none(_row_type(reports), "row"))
    till = Window.partitionBy("playlist", "b").orderBy("t", "side", "number").rowsBetween(Window.unboundedPreceding, 0)
    total = F.last(F.when(F.col("side") == 0, F.col("ms")), True).over(till)
    told = dealt(both.unionByName(heads), "playlist", "b").select("t", "side", "row", F.last("segment", True).over(till).alias("last"), total.alias("total_ms")).filter("side = 2")
    timed = told.select("row", "total_ms", F.when(F.col("t").isNotNull(), F.col("last")).alias("hit"))
    return timed.select("row.*", "hit.number", "hit.uri", "hit.start_ms", F.when(F.col("row.elapsed_ms").isNotNull(), percent_done(F.col("row.elapsed_ms"), F.col("total_ms"))).alias("percent"))


def _row_type(reports: DataFrame):
    from pyspark.sql.types import StructType

    return StructType(reports.schema.fields)
