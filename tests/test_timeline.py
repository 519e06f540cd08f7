"""Streams against the batch operators on shuffled arrival, and what is left in state."""

import random

import pytest

from codeframes.operators import frames, merge
from codeframes.streaming import timeline

FRAMES = "video_id string, path string, timestamp_ms bigint, phash bigint, text string"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timeline.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def shuffled(rows, rng, reach_ms):
    """Arrival order in which no row comes more than ``reach_ms`` late."""
    return sorted(rows, key=lambda r: r[2] + rng.uniform(0, reach_ms))


def corpus():
    rng = random.Random(3)
    rows = []
    for v in ("a", "b", None):
        for i in range(40):
            text = rng.choice(["def f(x):\n    return x", "def f(x):\n    retvrn x", "import os", None, f"row {i} stands alone here"])
            rows.append((v, f"/{v}/{rng.randrange(9)}", i * 700 + rng.randrange(300), rng.choice([None, 0, 1, 7, 255]), text))
    return rows


def run(spark, tmp_path, name, rows, stream):
    """All rows through files of fifteen, the last of which only moves the watermark on."""
    source = tmp_path / f"{name}-in"
    steps = [rows[i : i + 15] for i in range(0, len(rows), 15)] + [[("zz", "/end", 10_000_000, 0, "end")], [("zz", "/end2", 20_000_000, 0, "end")]]
    for i, some in enumerate(steps):
        spark.createDataFrame(some, FRAMES).coalesce(1).write.mode("append").parquet(str(source / f"{i:03d}"))
    out, at = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state")
    for i in range(len(steps)):  # a run a step: every one goes on from the state that the run before left
        got = stream(spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(source / f"{{{','.join(f'{k:03d}' for k in range(i + 1))},none}}")))
        if i in (3, len(steps) - 1):
            got.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).filter("video_id IS NULL OR video_id <> 'zz'"), at


def test_streams_equal_batch(rocks, tmp_path):
    spark, rows = rocks, corpus()
    arriving = shuffled(rows, random.Random(5), 9_000)
    batch = frames.with_seq(spark.createDataFrame(rows, FRAMES))
    kept, _ = run(spark, tmp_path, "runs", arriving, lambda s: timeline.collapse_runs(s, 1))
    want = frames.collapse_runs(batch, 1).select("video_id", "path", "timestamp_ms", "phash")
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    found, state = run(spark, tmp_path, "clusters", arriving, lambda s: timeline.cluster(s))
    want = merge.cluster(batch).select("video_id", "path", "timestamp_ms", "norm", "cluster_id")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    # every video but the one that moved the watermark is let go
    left = spark.read.format("statestore").option("stateVarName", "upto").load(state)
    assert {r.key.video_id for r in left.collect()} <= {"zz"}


def test_bounds():
    with pytest.raises(ValueError):
        timeline.collapse_runs(None, -1)
    with pytest.raises(ValueError):
        timeline.cluster(None, 2.0)
