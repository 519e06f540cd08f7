"""Scans, images, sinks, the plan and the stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeframes.plans.pipeline import FunctionBackend, Plan, TableBackend
from codeframes.schemas import Box, Settings
from codeframes.sources import images, logs, sinks, video
from codeframes.streaming.dedup import collapse_runs


def test_showinfo(spark):
    lines = ["[Parsed_showinfo_1 @ 0x1] n:   1 pts:  1000 pts_time:1.5", "[Parsed_metadata @ 0x2] pts_time:9", "[Parsed_showinfo_1 @ 0x1] n: 2 pts_time:-0.080000", "[Parsed_showinfo] n: 3 pts_time:x"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r.pts_ms for r in logs.showinfo_times(df).collect()] == [1500, 0]
    assert video.times_of("\n".join(lines[:3])) == [1500, 0]


def test_labelled_frames(spark, tmp_path):
    for name, truth in (("a", "import os\nx = 1\n\n"), ("b", "y")):
        (tmp_path / f"{name}.png").write_bytes(b"x")
        (tmp_path / f"{name}.txt").write_text(truth)
    (tmp_path / "c.png").write_bytes(b"x")
    assert sorted((r.name, r.truth) for r in logs.labelled_frames(spark, str(tmp_path)).collect()) == [("a", "import os\nx = 1"), ("b", "y")]
    for n in (2, 10, 1):
        (tmp_path / f"frame_{n:06d}.jpg").write_bytes(b"x")
    assert [r.number for r in logs.frame_files(spark, str(tmp_path)).orderBy("number").collect()] == [1, 2, 10]


def test_png_scan_crop_and_hash(spark, tmp_path):
    white = np.full((100, 100, 3), 255, np.uint8)
    white[10:30, 10:30] = (0, 0, 255)
    (tmp_path / "red.png").write_bytes(images.png_bytes(white))
    scanned = images.scan(spark, str(tmp_path))
    assert scanned.select("width", "height").first() == (100, 100)
    row = images.crop(scanned, Box(10, 10, 20, 20)).first()
    assert (images.pixels(row.height, row.width, row.channels, bytes(row.data)) == (0, 0, 255)).all() and (row.width, row.height) == (20, 20)
    for bad in (Box(90, 90, 20, 20), Box(0, 0, 0, 5), Box(-1, 0, 5, 5)):
        with pytest.raises(Exception, match="crop"):
            images.crop(scanned, bad).collect()
    assert scanned.select(images.png("height", "width", "channels", "data").alias("p")).first().p[:4] == b"\x89PNG"
    assert scanned.select(images.perceptual_hash("height", "width", "channels", "data")).first()[0] is not None


def test_hash_is_near_for_near_images_only():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (64, 80, 3)).astype(np.uint8)
    b = a.copy()
    b[:2, :2] ^= 8
    far = rng.integers(0, 256, (64, 80, 3)).astype(np.uint8)
    bits = lambda x, y: ((images.hash_of(x) ^ images.hash_of(y)) & (1 << 64) - 1).bit_count()
    assert bits(a, b) <= 4 < bits(a, far)


def test_video_source_checks_its_options(spark, tmp_path):
    for bad in ({"fps": 0}, {"scene": 0.0}, {"scene": 1.5}):
        with pytest.raises(ValueError):
            video.video_filter(bad.get("fps"), bad.get("scene"))
    spark.dataSource.register(video.FrameSource)
    reader = spark.read.format("video_frames").option("paths", str(tmp_path / "no.mp4")).option("out_dir", str(tmp_path))
    with pytest.raises(Exception, match="ffmpeg|No such file|no.mp4"):
        reader.load().collect()


def timeline(spark):
    rows = [("v", f"/f/{i}.jpg", 1000 * i, [0, 0, 255, 65535, 7 << 40][i]) for i in range(5)]
    return spark.createDataFrame(rows, "video_id string, path string, timestamp_ms bigint, phash bigint")


def readings(spark, texts, confidence):
    return spark.createDataFrame([("v", f"/f/{i}.jpg", t, c) for i, (t, c) in enumerate(zip(texts, confidence, strict=True))], "video_id string, path string, text string, confidence double")


def test_plan_with_second_reading(spark, tmp_path):
    first = TableBackend("first", readings(spark, ["import a", "import a", "import b", "only prose", "import zeta"], [0.9, 0.9, 0.2, 0.9, 0.2]))
    second = TableBackend("second", readings(spark, ["", "", "import bb", "", "not code"], [0.1] * 5))
    out = Plan(first, Settings(), second).run(timeline(spark))
    assert out.scripts.first().script == "import a\n\n\nimport bb\n\n\nimport zeta\n"
    stats = out.stats.first().asDict()
    assert (stats["frames_raw"], stats["frames_after_dedup"], stats["frames_passed_scoring"], stats["escalated_count"]) == (5, 4, 3, 2)
    assert {(r.path, r.text, r.escalated, r.adopted) for r in out.clustered.collect()} == {("/f/0.jpg", "import a", False, False), ("/f/2.jpg", "import bb", True, True), ("/f/4.jpg", "import zeta", True, False)}
    sinks.write_scripts(out.scripts, str(tmp_path / "s"))
    assert next((tmp_path / "s" / "video_id=v").glob("part-*")).read_text() == out.scripts.first().script
    document = sinks.provenance_json(out.provenance).first().document
    entries = json.loads(document)
    assert document.endswith("]\n") and [e["screenshot"] for e in entries] == ["/f/0.jpg", "/f/2.jpg", "/f/4.jpg"] and list(entries[0]) == ["timestamp", "screenshot", "raw_ocr", "cleaned_code"]
    sinks.write_provenance(out.provenance, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 3
    assert "After dedup:" in sinks.summary(stats) and "(20% removed)" in sinks.summary(stats)


def test_plan_with_a_function(spark):
    backend = FunctionBackend("fake", lambda: lambda paths: [(f"import m{p[3]}", 0.9) for p in paths])
    assert Plan(backend, Settings(similarity_threshold=1.0)).run(timeline(spark)).snippets.count() == 4


def test_stream_keeps_what_the_batch_keeps(spark, tmp_path):
    rows = [("v", f"/{i:03d}", i, h) for i, h in enumerate([0, 1, 255, 255, 0, 0, 31, 65535])]
    schema = "video_id string, path string, timestamp_ms bigint, phash bigint"
    source = str(tmp_path / "in")
    for part in (rows[:3], rows[3:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = collapse_runs(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    from codeframes.operators import frames

    want = frames.collapse_runs(frames.with_seq(spark.createDataFrame(rows, schema)))
    got = {r.path for r in spark.table("kept").collect()}
    assert got == {r.path for r in want.collect()}
    assert spark.table("kept").select(F.count_distinct("path")).first()[0] == len(got)


def test_backends_of_boxes_and_replies(spark):
    from codeframes.plans.backends import AnnotationBackend, TranscriptBackend, requests
    from codeframes.schemas import ANNOTATIONS

    frames = spark.createDataFrame([("v", 0, "/a", 0), ("v", 1, "/b", 1)], "video_id string, seq bigint, path string, timestamp_ms bigint")
    boxes = spark.createDataFrame([("v", "/a", 0, 100, 100, [("y", "0.5", [0.5, 0.8, 0.1, 0.1]), ("x", "1.0", [0.1, 0.8, 0.1, 0.1])]), ("v", "/b", 1, 100, 100, [])], ANNOTATIONS)
    got = {r.path: (r.text, r.confidence, r.backend) for r in AnnotationBackend("ocr", boxes).read(frames).collect()}
    assert got == {"/a": ("x y", 0.75, "ocr"), "/b": ("", 0.0, "ocr")}
    replies = spark.createDataFrame([("v", "/a", "```py\nx = [?]\n```", "stop"), ("v", "/b", None, "length")], "video_id string, path string, content string, finish_reason string")
    got = {r.path: (r.text, round(r.confidence, 9), r.backend) for r in TranscriptBackend("model", replies).read(frames).collect()}
    assert got == {"/a": ("x = [?]", 0.8, "model"), "/b": ("", 0.1, "model")}
    asked = requests(spark.createDataFrame([("a.jpg", b"12")], "path string, content binary"), "read").first().request
    assert json.loads(asked)["user"][0]["image_url"]["url"] == "data:image/jpeg;base64,MTI="


def test_crop_files(spark):
    pixels = np.arange(48, dtype=np.uint8).tobytes()
    df = spark.createDataFrame([("/x/a.png", 5, 4, 4, 3, pixels)], "path string, timestamp_ms bigint, height int, width int, channels int, data binary")
    row = images.crop_files(df, Box(1, 1, 2, 2)).first()
    assert row.name.startswith("a_5_") and row.name.endswith("_1_1_2_2.png") and row.content[:4] == b"\x89PNG"
