"""Lesson pages: links, stream addresses, and whether and how recordings may be merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeframes.functions import urls

# Fixed values of lesson pages.
STREAM_SCHEME, STREAM_ENDING, STREAM_FIELD = "https://", ".m3u8", "videoUrl"


def page_links(pages: DataFrame, base: str = "url", html: str = "html", containing: str = "/lesson/") -> DataFrame:
    """Distinct links of each page in the order in which they first occur, resolved against the page's address."""
    found = pages.select("page_id", F.col(base).alias("base"), F.posexplode(urls.anchors(F.col(html))).alias("pos", "href")).filter(F.col("href").contains(containing))
    first = found.withColumn("link", urls.resolve(F.col("base"), F.col("href"))).groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("page_id").orderBy("pos")
    return first.select("page_id", "link", F.row_number().over(order).alias("position"))


def _field_value(before, after):
    """What a quoted field holds whose name stands between ``before`` and ``after``, up to the playlist's ending; else null."""
    quotes = ("\"", "'")
    bare = lambda c: F.regexp_replace(c, r"\A\s+", "")
    colon = bare(F.substr(after, F.lit(2)))
    value = bare(F.substr(colon, F.lit(2)))
    body = F.split(F.substr(value, F.lit(2)), "[\"']")[0]
    end = F.locate(STREAM_ENDING[1:], body, 2)
    named = F.right(before, F.lit(1)).isin(*quotes) & F.left(after, F.lit(1)).isin(*quotes)
    return F.when(named & colon.startswith(":") & F.left(value, F.lit(1)).isin(*quotes) & (end > 0), F.substring(body, F.lit(1), end + len(STREAM_ENDING) - 2))


def stream_url(html):
    """The first https address of a playlist, or that of a ``videoUrl`` field."""
    words = F.split(html, r"""["'\s]""")
    # what stands behind the scheme must have something before the playlist's ending
    address = lambda w: F.substring_index(w, STREAM_SCHEME, -1)
    streams = F.filter(words, lambda w: w.contains(STREAM_SCHEME) & (F.locate(STREAM_ENDING, address(w)) > 1))
    direct = F.transform(streams, lambda w: F.concat(F.lit(STREAM_SCHEME), address(w)))
    parts = F.split(html, STREAM_FIELD)
    field = F.filter(F.transform(parts, lambda part, i: F.when(i > 0, _field_value(F.get(parts, i - 1), part))), lambda v: v.isNotNull())
    return F.coalesce(F.get(direct, F.lit(0)), F.get(field, F.lit(0)))


def probe_size(text):
    """``w,h`` of a media probe as a struct; null where it isn't two numbers."""
    parts = F.split(text, ",")
    w, h = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return F.when(w.isNotNull() & h.isNotNull() & (F.size(parts) == 2), F.struct(w.alias("width"), h.alias("height")))


def probe_seconds(text):
    """The duration that a media probe printed; null where it isn't a number."""
    return F.trim(text).try_cast("double")


def probe_has_audio(text):
    """Whether a probe for audio streams printed any; false where it failed."""
    return F.coalesce(F.trim(text) != "", F.lit(False))


def merge_decisions(lessons: DataFrame, force: bool = False) -> DataFrame:
    """Per course (has_stream, downloaded, width, height): merge or not, by copy or anew, and the padded size."""
    even = lambda c: F.max(c) + F.pmod(F.max(c), F.lit(2))
    found = lessons.groupBy("course").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if("has_stream").alias("n_streams"), F.count_if(F.col("has_stream") & F.col("downloaded")).alias("n_downloaded"),
        F.count_distinct(F.when(F.col("downloaded"), F.struct("width", "height"))).alias("n_sizes"), even("width").alias("pad_width"), even("height").alias("pad_height"),
    )
    partial = (F.col("n_downloaded") < F.col("n_streams")) | ((F.col("n_streams") < F.col("n_pages")) & F.lit(not force))
    mode = F.when((F.col("n_downloaded") == 0) | partial, "skip").when(F.col("n_sizes") <= 1, "copy").otherwise("recode")
    return found.withColumn("mode", mode)
