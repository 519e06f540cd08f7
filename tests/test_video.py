"""From images to scripts, without ffmpeg: frames that are already images, and readers that know their pixels."""

import json
import os
import stat

import numpy as np
import pytest

from codeframes import cli
from codeframes.plans import video
from codeframes.plans.pipeline import Plan, TableBackend
from codeframes.schemas import Box, Settings
from codeframes.sources import images

FRAMES = "video_id string, path string, timestamp_ms bigint"


def picture(kind: int, noise: int = 0) -> np.ndarray:
    rng = np.random.default_rng(kind)
    image = np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    image[:4, :4] = kind * 10
    image[63, 63] = noise
    return image


@pytest.fixture
def shots(tmp_path):
    folder = tmp_path / "shots"
    folder.mkdir()
    rows = []
    for i, kind in enumerate([1, 1, 2, 3, 1]):
        path = folder / f"frame_{i}.png"
        path.write_bytes(images.png_bytes(picture(kind, i)))
        rows.append(("v.mp4", str(path), 1000 * i))
    return folder, rows


def setup():
    """Reads the grey level of the first pixel, and the picture's size."""
    import struct
    import zlib

    def read(pngs):
        out = []
        for png in pngs:
            width, height = struct.unpack(">II", png[16:24])
            at = png.index(b"IDAT") + 4
            first = zlib.decompressobj().decompress(png[at:])[1]
            out.append((f"import m{first}_{width}x{height}", 0.9 if first != 20 else 0.1))
        return out

    return read


def second_setup():
    return lambda pngs: [("import better", 0.9) for _ in pngs]


def test_frames_to_script(spark, shots):
    folder, rows = shots
    pictures = images.scan(spark, str(folder))
    timeline = video.hashed(spark.createDataFrame(rows, FRAMES), pictures)
    assert len({r.phash for r in timeline.collect()}) == 3
    out = Plan(video.ImageBackend("pixels", setup, pictures), Settings(similarity_threshold=1.0)).run(timeline)
    assert out.scripts.first().script == "import m10_64x64\n\n\nimport m20_64x64\n\n\nimport m30_64x64\n"
    stats = out.stats.first()
    assert (stats.frames_raw, stats.frames_after_dedup, stats.snippets_merged) == (5, 4, 3)
    cut = Plan(video.ImageBackend("pixels", setup, pictures, Box(0, 0, 4, 3)), Settings(similarity_threshold=1.0), video.ImageBackend("again", second_setup, pictures)).run(timeline)
    assert cut.scripts.first().script == "import m10_4x3\n\n\nimport better\n\n\nimport m30_4x3\n"
    assert cut.stats.first().escalated_count == 1
    assert {r.screenshot for r in cut.provenance.collect()} <= {p for _, p, _ in rows}
    with pytest.raises(Exception, match="beyond the image"):
        Plan(video.ImageBackend("pixels", setup, pictures, Box(60, 0, 10, 10)), Settings()).run(timeline)


def test_crops_as_files(spark, shots, tmp_path):
    folder, rows = shots
    seen = video.with_pixels(spark.createDataFrame(rows, FRAMES), images.scan(spark, str(folder)))
    out = images.write_crops(seen, Box(1, 2, 5, 6), str(tmp_path / "crops")).collect()
    assert {r.name for r in out} == set(os.listdir(tmp_path / "crops")) and len(out) == 5
    again = images.scan(spark, str(tmp_path / "crops")).collect()
    assert all((r.height, r.width) == (6, 5) for r in again)


def test_frames_without_image_or_reading(spark, shots):
    folder, rows = shots
    frames = spark.createDataFrame([*rows, ("v.mp4", "/no/image.png", 9000)], FRAMES)
    with pytest.raises(Exception, match="no image of the frame /no/image.png"):
        video.hashed(frames, images.scan(spark, str(folder))).collect()
    timeline = video.hashed(spark.createDataFrame(rows, FRAMES), images.scan(spark, str(folder)))
    some = spark.createDataFrame([("v.mp4", rows[0][1], "import a", 0.9)], "video_id string, path string, text string, confidence double")
    with pytest.raises(Exception, match="no reading of the frame"):
        Plan(TableBackend("first", some), Settings()).run(timeline)


def client():
    def ask(request):
        uri = request["messages"][1]["content"][0]["image_url"]["url"]
        assert request["temperature"] == 0 and request["messages"][0]["content"] == "read" and uri.startswith("data:image/png;base64,")
        return {"choices": [{"message": {"content": "```py\nimport a\n```"}, "finish_reason": "length"}]}

    return ask


def mute_client():
    return lambda request: {"choices": []}


def silent_client():
    return lambda request: {"choices": [{"message": {"content": None}, "finish_reason": "stop"}]}


def test_model_backend(spark, shots):
    folder, rows = shots
    pictures = images.scan(spark, str(folder))
    frames = spark.createDataFrame([(v, i, p, t) for i, (v, p, t) in enumerate(rows)], "video_id string, seq bigint, path string, timestamp_ms bigint")
    got = video.ModelBackend("model", client, pictures, "read").read(frames).collect()
    assert {(r.text, r.confidence, r.backend) for r in got} == {("import a", 0.3, "model")} and len(got) == 5
    assert {(r.text, r.confidence) for r in video.ModelBackend("model", silent_client, pictures, "read").read(frames).collect()} == {("", 0.1)}
    with pytest.raises(Exception, match="no choices"):
        video.ModelBackend("model", mute_client, pictures, "read").read(frames)


FAKE = """#!{python}
import re, sys
sys.path.insert(0, {root!r})
from tests.test_video import picture
from codeframes.sources.images import png_bytes
out, chain = sys.argv[-1], sys.argv[sys.argv.index("-vf") + 1]
kinds = [2] if "scene" in chain else [1, 1, 3]
for i, kind in enumerate(kinds):
    open(out % (i + 1), "wb").write(png_bytes(picture(kind)))
    print(f"[Parsed_showinfo_1 @ 0x1] n:{{i:4d}} pts: 1 pts_time:{{i * 2 + ('scene' in chain)}}", file=sys.stderr)
"""


@pytest.fixture
def ffmpeg(tmp_path, monkeypatch):
    """A stand-in that writes pictures and a log in the shape of the real tool's."""
    import sys

    tool = tmp_path / "bin" / "ffmpeg"
    tool.parent.mkdir()
    tool.write_text(FAKE.format(python=sys.executable, root=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    tool.chmod(tool.stat().st_mode | stat.S_IEXEC)
    monkeypatch.setenv("PATH", f"{tool.parent}:{os.environ['PATH']}")
    monkeypatch.setattr("codeframes.sources.video.require", lambda tool_name="ffmpeg": str(tool))
    return tool


def test_decoding_pairs_images_with_times(ffmpeg, tmp_path):
    from codeframes.sources.video import decode

    movie = tmp_path / "a b.mp4"
    movie.write_bytes(b"x")
    got = decode(str(movie), str(tmp_path / "out"), 1.0, None)
    assert [(v, t) for v, _, t in got] == [(str(movie), 0), (str(movie), 2000), (str(movie), 4000)]
    assert len(decode(str(movie), str(tmp_path / "out"), None, 0.3)) == 1 and len(decode(str(movie), str(tmp_path / "out"), 1.0, None)) == 3


def movies(folder, *names):
    folder.mkdir(exist_ok=True)
    for name in names:
        (folder / name).write_bytes(b"x")
    return [str(folder / name) for name in names]


def test_attempts_have_folders_of_their_own(ffmpeg, tmp_path):
    from codeframes.sources.video import decode

    (movie,) = movies(tmp_path / "in", "a.mp4")
    first, second = (decode(movie, str(tmp_path / "out"), 1.0, None) for _ in range(2))
    assert not {i for _, i, _ in first} & {i for _, i, _ in second}
    assert all(os.path.isfile(i) for _, i, _ in first + second)


def test_filters_reach_the_source(spark, ffmpeg, tmp_path):
    from pyspark.sql import functions as F

    from codeframes.sources.video import register

    register(spark)
    paths = movies(tmp_path / "in", "a.mp4", "b,c.mp4", "d.mp4")
    frames = spark.read.format("video_frames").option("paths", json.dumps(paths)).option("ffmpeg", str(ffmpeg)).option("out_dir", str(tmp_path / "out")).load()
    assert frames.count() == 9
    tried = lambda: len(list((tmp_path / "out").glob("*/*")))
    before = tried()
    got = frames.filter((F.col("video_id") == paths[1]) & (F.col("timestamp_ms") > 0) & (F.col("timestamp_ms") < 4000) & F.col("path").endswith("2.jpg")).collect()
    assert [(r.video_id, r.timestamp_ms) for r in got] == [(paths[1], 2000)] and tried() == before + 1
    assert frames.filter(F.col("video_id").isin(paths[0], paths[2], "none")).filter("timestamp_ms = 4000").count() == 2 and tried() == before + 3
    assert frames.filter("timestamp_ms >= 2000 and timestamp_ms <= 2000").count() == 3
    assert frames.filter("video_id = 'none'").count() == 0


def test_stream_of_a_growing_folder(spark, ffmpeg, tmp_path):
    from codeframes.sources.video import _StreamReader, register

    register(spark)
    inbox, log = tmp_path / "in", tmp_path / "log"

    def run():
        frames = spark.readStream.format("video_frames").option("folder", str(inbox)).option("log_dir", str(log)).option("ffmpeg", str(ffmpeg)).option("out_dir", str(tmp_path / "out")).load()
        query = frames.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt")).start(str(tmp_path / "table"))
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((os.path.basename(r.video_id), r.timestamp_ms) for r in spark.read.parquet(str(tmp_path / "table")).collect())

    times = (0, 2000, 4000)
    movies(inbox, "m.mp4", "n.mp4", "_part.mp4")
    assert run() == [(v, t) for v in ("m.mp4", "n.mp4") for t in times]
    (inbox / "_part.mp4").rename(inbox / "a.mp4")  # sorts before what was seen
    assert run() == [(v, t) for v in ("a.mp4", "m.mp4", "n.mp4") for t in times]
    assert len(run()) == 9

    options = {"folder": str(inbox), "log_dir": str(log), "out_dir": "x"}
    again = _StreamReader(options)
    names = lambda a, b: [os.path.basename(p.path) for p in again.partitions({"files": a}, {"files": b})]
    assert names(0, 2) == ["m.mp4", "n.mp4"] and names(2, 3) == ["a.mp4"]
    with pytest.raises(ValueError, match="offset counts 4"):
        again.partitions({"files": 0}, {"files": 4})
    with pytest.raises(ValueError, match="log_dir"):
        _StreamReader({"out_dir": "x", "folder": str(inbox)})


def test_cli_errors(tmp_path, capsys):
    err = lambda *args: (cli.main(["extract", *args]), capsys.readouterr().err)
    assert err("no.mp4", "--backend", "tests.test_video:setup") == (1, "codeframes: error: no such video: no.mp4\n")
    assert err("a", "--readings", "r", "--crop", "1,2,3,4")[0] == 1
    assert "a crop" in err("a.mp4", "--backend", "tests.test_video:setup", "--crop", "1,2")[1]
    assert "MODULE:SETUP" in err("a.mp4", "--backend", "nothing")[1]
    assert "scene_threshold must be above 0 and at most 1, not 0.0" in err("a.mp4", "--backend", "tests.test_video:setup", "--scene-threshold", "0")[1]
    for wrong in (["a"], ["a", "--readings", "r", "--backend", "m:s"], ["a", "--readings", "r", "--fps", "x"]):
        with pytest.raises(SystemExit) as stop:
            cli.main(["extract", *wrong])
        assert stop.value.code == 2
