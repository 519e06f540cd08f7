"""Queries over the driver's tables: one per operator, with scalar columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeframes.functions import scoring, text
from codeframes.operators import crawl, escalate, evaluate, frames, layout, merge, playlist, similar
from codeframes.plans import corpora, video
from codeframes.plans.corpora import table
from codeframes.plans.oracles import ORACLES  # noqa: F401
from codeframes.plans.pipeline import Plan, TableBackend
from codeframes.schemas import Box, Settings
from codeframes.sources import images, logs

Spark = SparkSession
S6 = lambda c: F.round(c, 6)


def timecode(spark: Spark, d: str) -> DataFrame:
    return corpora.signals(spark, d).select("event_id", text.timecode("timestamp_ms").alias("timecode"))


def frame_union(spark: Spark, d: str) -> DataFrame:
    s = corpora.signals(spark, d).select("video_id", "path", "timestamp_ms", "event_type", (F.col("value") / 100).alias("scene_score"))
    cuts = frames.scene_cuts(s.filter("event_type = 'view'"), 0.3)
    cols = ["video_id", "path", "timestamp_ms"]
    return frames.union_frames(s.filter("event_type = 'click'").select(*cols), cuts.select(*cols))


def fps_sample(spark: Spark, d: str) -> DataFrame:
    return frames.sample_fps(corpora.signals(spark, d), 0.00001).select("video_id", "event_id", "timestamp_ms")


def showinfo_pts(spark: Spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "value")
    sign = F.when(F.col("event_id") % 5 == 0, "-").otherwise("")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[Parsed_metadata_1] pts_time:"), F.col("value").cast("string"))).otherwise(
        F.concat(F.lit("[Parsed_showinfo_1 @ 0x1] n:   1 pts:  10 pts_time:"), sign, F.col("value").cast("string"), F.lit(" fmt:yuv"))
    )
    return logs.showinfo_times(e.withColumn("line", line)).select("event_id", "pts_ms")


def pair_frames(spark: Spark, d: str) -> DataFrame:
    s = corpora.signals(spark, d)
    left = s.filter("event_type = 'click'").select("video_id", F.col("event_id").alias("frame_id"))
    right = s.filter("event_type = 'view'").select("video_id", F.col("event_id").alias("time_id"))
    paired = frames.pair_by_ordinal(left, right, ["video_id"], [F.col("frame_id")], [F.col("time_id")], strict=False)
    return paired.select("video_id", F.col("ordinal").cast("long").alias("ordinal"), "frame_id", "time_id")


def suffix_order(spark: Spark, d: str) -> DataFrame:
    path = F.concat(F.lit("/x_y/frame_"), F.lpad((F.col("event_id") * 7 % 1000).cast("string"), 6, "0"), F.lit(".jpg"))
    return table(spark, d, "events").select("event_id", frames.numeric_suffix(path).alias("number"))


def dedup_runs(spark: Spark, d: str) -> DataFrame:
    return frames.collapse_runs(corpora.signals(spark, d).select("video_id", "seq", "phash"), max_distance=3)


def sign_hash(spark: Spark, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    s = F.array_sort(x)
    median = (F.element_at(s, 32) + F.element_at(s, 33)) / 2
    rows = table(spark, d, "embeddings").filter(F.size("embedding") == 64).select("vec_id", x.alias("x"), median.alias("m"))
    return rows.select("vec_id", F.array_join(F.transform("x", lambda v: F.when(v > F.col("m"), "1").otherwise("0")), "").alias("bits"))


def bbox_pixels(spark: Spark, d: str) -> DataFrame:
    box = F.array(F.col("l_discount") * 9, F.col("l_tax") * 12, F.col("l_quantity") / 100, F.col("l_discount") + 0.05)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", layout.pixel_box(box, F.lit(1920), F.lit(1080)).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "b.x", "b.y", "b.width", "b.height")


def line_groups(spark: Spark, d: str) -> DataFrame:
    item = F.struct("y", "x", "ord", "width", "height", "text")
    rows = corpora.boxes(spark, d).groupBy("l_orderkey").agg(F.collect_list(item).alias("items")).select("l_orderkey", layout.lines(F.col("items")).alias("lines"))
    return rows.select("l_orderkey", F.size("lines").cast("long").alias("n_lines"), F.replace(layout.reading_text(F.col("lines")), F.lit("\n"), F.lit("/")).alias("text"))


def annotation_text(spark: Spark, d: str) -> DataFrame:
    """Annotations in fractions, some malformed, through pixels and lines to an extraction."""
    b = corpora.boxes(spark, d)
    short = F.col("ord") == 5
    box = F.when(short, F.array(F.lit(0.1), F.lit(0.1))).otherwise(F.array(F.col("x") / 256.0, F.col("y") / 64.0, F.lit(0.0625), F.col("height") / 64.0))
    confidence = F.when(F.col("ord") == 6, F.lit("high")).otherwise((F.col("height") / 16).cast("string"))
    ann = F.struct(F.col("ord").alias("o"), F.col("text").alias("text"), confidence.alias("confidence"), box.alias("box"))
    grouped = b.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(ann)).alias("found"))
    given = grouped.select(
        F.col("l_orderkey").cast("string").alias("video_id"), F.lit("p").alias("path"), F.lit(0).cast("long").alias("timestamp_ms"), F.lit(256).alias("img_width"), F.lit(64).alias("img_height"),
        F.transform("found", lambda a: F.struct(a["text"].alias("text"), a["confidence"].alias("confidence"), a["box"].alias("box"))).alias("ann"),
    )
    out = layout.extractions(given)
    return out.select("video_id", F.replace("text", F.lit("\n"), F.lit("/")).alias("text"), S6("confidence").alias("confidence"), F.size("bboxes").cast("long").alias("n_boxes"))


def box_union(spark: Spark, d: str) -> DataFrame:
    return layout.box_union(corpora.boxes(spark, d), ["l_orderkey"])


def crop_name(spark: Spark, d: str) -> DataFrame:
    s = corpora.signals(spark, d)
    name = images.crop_name(F.concat("path", F.lit(".v1.jpg")), F.col("timestamp_ms"), F.lit(1), F.lit(2), F.lit(30), F.lit(40))
    return s.select("event_id", name.alias("name"))


def artifact_names(spark: Spark, d: str) -> DataFrame:
    path = F.when(F.col("page_id") % 3 == 0, F.lit("/a/b/")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/v/talk."), F.col("page_id").cast("string"), F.lit(".mp4"))).otherwise(F.lit(""))
    return table(spark, d, "pages").select("page_id", text.artifact_base(path).alias("base"))


def data_uris(spark: Spark, d: str) -> DataFrame:
    path = F.concat(F.lit("x."), F.when(F.col("page_id") % 2 == 0, "jpg").otherwise("dat"))
    return table(spark, d, "pages").select("page_id", F.sha2(text.data_uri(path, F.coalesce("html", F.lit("")).cast("binary")), 256).alias("uri_sha"))


def fence_strip(spark: Spark, d: str) -> DataFrame:
    return corpora.transcripts(spark, d).select("video_id", "seq", text.strip_fence("content").alias("text"))


def llm_confidence(spark: Spark, d: str) -> DataFrame:
    found = text.transcript_confidence(text.strip_fence("content"), "finish_reason")
    return corpora.transcripts(spark, d).select("video_id", "seq", S6(found).alias("confidence"))


def signal_hits(spark: Spark, d: str) -> DataFrame:
    return corpora.code_texts(spark, d).select("id", *(scoring.signal("text", name).alias(name) for name in scoring.WEIGHTS))


def code_score(spark: Spark, d: str) -> DataFrame:
    return corpora.code_texts(spark, d).select("id", scoring.code_score("text").alias("score"))


def gate(spark: Spark, d: str) -> DataFrame:
    return escalate.gate(corpora.takes(spark, d)).select("video_id", "seq", "score")


def normalize_text(spark: Spark, d: str) -> DataFrame:
    noisy = F.concat(F.lit("\n \n"), F.replace(F.coalesce("text", F.lit("")), F.lit("."), F.lit(". \t\n")), F.lit("  \n\n"))
    n = text.normalize(noisy)
    return table(spark, d, "documents").select("doc_id", F.length(n).cast("long").alias("n_chars"), F.sha2(n, 256).alias("sha"))


def similarity_pairs(spark: Spark, d: str) -> DataFrame:
    """Each benchmark text and the next ones by id, so that the pairs grow as the texts do."""
    b = table(spark, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("t"))
    left = b.select(F.col("item_id").alias("a"), F.col("t").alias("ta"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: k + F.col("item_id"))).alias("b"))
    both = left.join(b.select(F.col("item_id").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", F.levenshtein("ta", "tb").cast("long").alias("distance"), S6(text.similarity("ta", "tb")).alias("similarity"), text.similar(F.col("ta"), F.col("tb"), 0.3).alias("near"))


def similarity_join(spark: Spark, d: str) -> DataFrame:
    """All readings of all benchmark texts: each one's class of equal texts, and how many other classes are similar."""
    rows = corpora.predictions(spark, d).select(F.concat_ws("/", "backend", "name").alias("reading"), "text")
    return similar.similarity_join(rows, "reading", "text", 0.8).select("reading", "class_id", "n_links")


def _clustered(spark: Spark, d: str) -> DataFrame:
    return merge.cluster(escalate.gate(corpora.takes(spark, d)))


def clusters(spark: Spark, d: str) -> DataFrame:
    return merge.cluster(corpora.takes(spark, d)).select("video_id", "seq", "cluster_id")


def representatives(spark: Spark, d: str) -> DataFrame:
    found = merge.snippets(merge.cluster(corpora.takes(spark, d)))
    return found.select("video_id", "cluster_id", "code", F.array_join(F.transform("sources", lambda s: s["path"]), "|").alias("sources"), "position")


def notes(spark: Spark, d: str) -> DataFrame:
    found = merge.snippets(merge.cluster(corpora.takes(spark, d)))
    return found.select("video_id", "cluster_id", "low_confidence", "conflict", merge.notes().alias("notes"))


def script(spark: Spark, d: str) -> DataFrame:
    return merge.scripts(merge.snippets(_clustered(spark, d)))


def provenance(spark: Spark, d: str) -> DataFrame:
    clustered = _clustered(spark, d)
    return merge.provenance(clustered, merge.snippets(clustered)).select("video_id", "entry", "timestamp", "screenshot", "raw_ocr", "cleaned_code")


def merge_function(spark: Spark, d: str) -> DataFrame:
    """Snippets whose code an injected expression makes of their members."""
    clustered = merge.cluster(corpora.takes(spark, d))
    longest = F.array_max(F.transform("members", lambda m: F.struct(F.length(m["text"]).alias("n"), m["text"].alias("t"))))["t"]
    return merge.with_merge_function(merge.snippets(clustered), clustered, longest).select("video_id", "cluster_id", "code")


def escalation(spark: Spark, d: str) -> DataFrame:
    passed = escalate.gate(corpora.takes(spark, d))
    second = corpora.second_takes(spark, d).join(escalate.doubtful(passed).select("video_id", "seq"), ["video_id", "seq"], "left_semi")
    return escalate.adopt(passed, second).select("video_id", "seq", "text", "confidence", "escalated", "adopted")


def _plan(spark: Spark, d: str):
    t = corpora.takes(spark, d)
    timeline = t.select("video_id", "path", "timestamp_ms", F.floor(F.col("timestamp_ms") / 2000).cast("long").alias("phash"))
    return Plan(TableBackend("first", t), Settings(dedup_max_distance=0), TableBackend("second", corpora.second_takes(spark, d))).run(timeline)


def extract_plan(spark: Spark, d: str) -> DataFrame:
    """The whole plan: dedup, two readings, gate, merge and script."""
    return _plan(spark, d).scripts


def run_stats(spark: Spark, d: str) -> DataFrame:
    return _plan(spark, d).stats


def tokens(spark: Spark, d: str) -> DataFrame:
    rows = corpora.predictions(spark, d).select("backend", "name", F.posexplode(text.tokens("text")).alias("pos", "token"))
    return rows.groupBy("backend", "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first_pos"))


def token_accuracy(spark: Spark, d: str) -> DataFrame:
    return corpora.predictions(spark, d).select("backend", "name", S6(text.token_accuracy("text", "truth")).alias("accuracy"))


def _report(spark: Spark, d: str) -> DataFrame:
    return evaluate.benchmark(evaluate.score_predictions(corpora.predictions(spark, d)))


def backend_eval(spark: Spark, d: str) -> DataFrame:
    return _report(spark, d).select("backend", S6("mean_levenshtein").alias("mean_levenshtein"), S6("mean_token_acc").alias("mean_token_acc"), S6("aggregate").alias("aggregate"), "n_frames")


def winner(spark: Spark, d: str) -> DataFrame:
    order = spark.createDataFrame([("errs", 0), ("copy", 1), ("fails", 2)], "backend string, ordinal int")
    return evaluate.winner(_report(spark, d), order)


def page_links(spark: Spark, d: str) -> DataFrame:
    return crawl.page_links(table(spark, d, "pages"), containing="/").select("page_id", "link", F.col("position").cast("long").alias("position"))


def stream_urls(spark: Spark, d: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    html = F.concat(
        F.coalesce("html", F.lit("")),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<script src="https://cdn.x/v'), i, F.lit('.m3u8?t=1">')))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("{'videoUrl' : 'http://h/"), i, F.lit(".m3u8'}")))
        .otherwise(F.lit("")),
    )
    return table(spark, d, "pages").select("page_id", crawl.stream_url(html).alias("stream"))


def slugs(spark: Spark, d: str) -> DataFrame:
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.regexp_extract("url", r"^([a-z]+://[^/]*)", 1), F.lit("/"))).otherwise(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/a (b)~c-/?q=1")))
    return table(spark, d, "pages").select("page_id", text.url_slug(url).alias("lesson"), text.url_slug(url, "course").alias("course"))


def size_text(spark: Spark, d: str) -> DataFrame:
    n = F.floor(F.col("l_extendedprice") * F.pow(F.lit(10.0), (F.col("l_linenumber") - 3).cast("double"))).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.size_text(n).alias("size"))


def duration_text(spark: Spark, d: str) -> DataFrame:
    s = F.floor(F.col("o_totalprice") / 20)
    hms = F.concat_ws(":", F.floor(s / 3600).cast("string"), F.pmod(F.floor(s / 60), F.lit(60)).cast("string"), F.concat(F.pmod(s, F.lit(60)).cast("string"), F.lit(".5")))
    return table(spark, d, "orders").select("o_orderkey", text.clock(s).alias("clock"), text.hours_minutes(s).alias("hours"), text.hms_to_seconds(hms).alias("seconds"), text.hms_to_seconds(F.lit("1:2")).alias("bad"))


def progress(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.percent_done(F.col("l_quantity") * 3, F.col("l_linenumber") * 20 - 20).cast("int").alias("percent"))


def playlist_progress(spark: Spark, d: str) -> DataFrame:
    """Orders as playlists whose segments are their lines, and the segment and percent of elapsed times."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    tasks = playlist.tasks_for(items)
    parts = items.repartition(tasks, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("seconds"))
    number = F.col("l_linenumber").cast("string")
    length = F.when(F.col("l_linenumber") == 4, F.lit("#EXTINF:none,")).otherwise(F.concat(F.lit("#EXTINF:"), F.col("seconds").cast("string"), F.lit(",x")))
    both = F.posexplode(F.array(F.lit("# part"), length, F.concat(F.lit("part_"), number, F.lit(".ts"))))
    lines = parts.select(F.col("l_orderkey").alias("playlist"), "l_linenumber", both.alias("k", "line")).select("playlist", (F.col("l_linenumber") * 3 + F.col("k")).alias("line_no"), "line")
    reports = items.select(F.col("l_orderkey").alias("playlist"), "l_orderkey", "l_linenumber", (F.floor("l_extendedprice") * 5 - 9000).cast("long").alias("elapsed_ms"))
    return playlist.located(reports, playlist.segments(lines), bucket_ms=20_000, tasks=tasks).drop("playlist")


def probe_sizes(spark: Spark, d: str) -> DataFrame:
    raw = F.when(F.col("l_linenumber") == 1, F.concat("l_partkey", F.lit(","), "l_suppkey")).when(F.col("l_linenumber") == 2, F.lit("N/A")).otherwise(F.lit("12,x"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", crawl.probe_size(raw).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", "s.width", "s.height")


def merge_mode(spark: Spark, d: str) -> DataFrame:
    return crawl.merge_decisions(corpora.lessons(spark, d)).select("course", "n_pages", "n_streams", "n_downloaded", "n_sizes", "pad_width", "pad_height", "mode")


def _pictures(spark: Spark, d: str) -> DataFrame:
    """Small grey images whose pixels are the components of the vectors."""
    level = F.transform("embedding", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 127).cast("int")))), 2, "0"))
    return table(spark, d, "embeddings").filter(F.size("embedding") == 64).select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(level, "")).alias("data"))


def image_phash(spark: Spark, d: str) -> DataFrame:
    return _pictures(spark, d).select("vec_id", images.perceptual_hash("height", "width", "channels", "data").alias("phash"))


def read_pictures(spark: Spark, d: str) -> DataFrame:
    """Pictures as frames of videos of fifty: hash, run collapse, crop and a reader that knows pixels.

    Vectors of another length than a picture's 64 pixels are no pictures."""
    pictures = _pictures(spark, d).withColumn("path", F.concat(F.lit("/shots/"), F.col("vec_id").cast("string"), F.lit(".png")))
    shots = pictures.select(F.floor(F.col("vec_id") / 50).cast("string").alias("video_id"), "path", (F.col("vec_id") % 50 * 1000).alias("timestamp_ms"))
    kept = frames.collapse_runs(frames.with_seq(video.hashed(shots, pictures)), max_distance=24)

    def setup():
        import zlib

        def read(pngs):  # the first grey level of the region, as a line of code
            levels = [zlib.decompress(p[p.index(b"IDAT") + 4 : p.index(b"IEND") - 8])[1] for p in pngs]
            return [(f"import m{n}", n / 256) for n in levels]

        return read

    got = video.ImageBackend("levels", setup, pictures, Box(2, 1, 4, 3)).read(kept)
    return got.select("video_id", "path", "text", "confidence")


def image_crop(spark: Spark, d: str) -> DataFrame:
    cut = images.crop(_pictures(spark, d), Box(2, 1, 4, 3))
    return cut.select("vec_id", F.hex("data").alias("pixels"), "width", "height")


def _named() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        timecode, frame_union, fps_sample, showinfo_pts, pair_frames, suffix_order, dedup_runs, sign_hash, bbox_pixels, line_groups, annotation_text, box_union, crop_name,
        artifact_names, data_uris, fence_strip, llm_confidence, signal_hits, code_score, gate, normalize_text, similarity_pairs, similarity_join, clusters, representatives, notes, script,
        provenance, merge_function, escalation, extract_plan, run_stats, tokens, token_accuracy, backend_eval, winner, page_links, stream_urls, slugs, size_text, duration_text,
        progress, playlist_progress, probe_sizes, merge_mode, image_phash, image_crop, read_pictures,
    ]
    return {f.__name__: f for f in made}


QUERIES = _named()
