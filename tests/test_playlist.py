"""Playlists against a loop over their lines."""

import random

import pytest

from codeframes.operators import playlist


def plain(lines, reports):
    found, total = {}, {}
    for p in {l[0] for l in lines}:
        at, length, own = 0, 0, []
        for _, _, line in sorted((l for l in lines if l[0] == p), key=lambda l: l[1]):
            line = line.strip(" ")
            if line.startswith("#EXTINF:"):
                try:
                    length = round(float(line[8:].split(",")[0]) * 1000)
                except ValueError:
                    length = 0
            elif line and not line.startswith("#"):
                own.append((at, len(own), line))
                at, length = at + length, 0
        found[p], total[p] = own, at
    out = []
    for p, i, ms in reports:
        hit = [s for s in found.get(p, []) if ms is not None and s[0] <= ms]
        start, number, uri = hit[-1] if hit else (None, None, None)
        whole = total.get(p)
        out.append((p, i, ms, number, uri, start, min(100, ms * 100 // whole) if whole and ms is not None else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [1_000, 7_000, playlist.BUCKET_MS])
def test_located(spark, bucket):
    rng = random.Random(bucket)
    lines, reports = [], []
    for p in ("a", "b", None, "empty"):
        k = 0
        for i in range(0 if p == "empty" else 40):
            for line in rng.choice([["#EXTINF:4.5,t", f"s{i}.ts"], ["#EXTINF:x,", "", "#EXTINF:2,", f" s{i}.ts "], [f"s{i}.ts"], ["# note", "#EXTINF:0,", f"s{i}.ts"], ["#EXTINF:9,"]]):
                lines.append((p, k, line))
                k += 1
        reports += [(p, i, rng.choice([None, -5, 0, rng.randrange(200_000)])) for i in range(60)]
    reports += [("nowhere", 1, 5), reports[0]]
    got = playlist.located(spark.createDataFrame(reports, "playlist string, i int, elapsed_ms bigint"), playlist.segments(spark.createDataFrame(lines, "playlist string, line_no int, line string")), bucket)
    assert sorted(map(tuple, got.select("playlist", "i", "elapsed_ms", "number", "uri", "start_ms", "percent").collect()), key=repr) == plain(lines, reports)


def test_tasks_grow_with_the_rows(spark, sf_dir, monkeypatch):
    from codeframes.plans.queries import QUERIES

    want = sorted(map(tuple, QUERIES["playlist_progress"](spark, sf_dir).collect()), key=repr)
    monkeypatch.setattr(playlist, "ROWS_EACH", 500)
    got = QUERIES["playlist_progress"](spark, sf_dir)
    assert got.rdd.getNumPartitions() == -(-len(want) // 500) > 4
    assert sorted(map(tuple, got.collect()), key=repr) == want
