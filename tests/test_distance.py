"""Bit-parallel distances and the seed index against plain tables and loops."""

import random
import time

import pytest

from codeframes.functions.distance import SeedIndex, distances, segments


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def edited(rng, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice(letters))
        elif out and kind == 1:
            out.pop(at % len(out))
        elif out:
            out[at % len(out)] = rng.choice(letters)
    return "".join(out)


LETTERS = "ab é漢\U0001f600\n"


def pairs(rng, n, longest):
    made = []
    for _ in range(n):
        a = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(longest)))
        b = edited(rng, a, rng.randrange(12), LETTERS) if rng.random() < 0.6 else "".join(rng.choice(LETTERS) for _ in range(rng.randrange(longest)))
        made.append((a, b))
    return made


@pytest.mark.parametrize("n,longest", [(400, 12), (300, 140), (60, 400), (5, 300)])
def test_distances_are_those_of_the_table(n, longest):
    rng = random.Random(n)
    made = pairs(rng, n, longest)
    want = [table_distance(a, b) for a, b in made]
    assert distances(*map(list, zip(*made, strict=True))).tolist() == want
    most = [rng.randrange(20) for _ in made]
    assert distances([a for a, _ in made], [b for _, b in made], most).tolist() == [d if d <= m else -1 for d, m in zip(want, most, strict=True)]


def test_lone_surrogates_and_empty():
    assert distances(["\ud800a", "", "x"], ["a", "", ""]).tolist() == [1, 0, 1] and distances([], []).tolist() == []


def test_long_texts_in_time():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdef ") for _ in range(12_000)) for _ in range(4)]
    start = time.perf_counter()
    found = distances([texts[0]] * 3, texts[1:])
    assert time.perf_counter() - start < 5 and all(0 < d < 12_000 for d in found)


def test_distances_are_those_of_the_engine(spark):
    from pyspark.sql import functions as F

    made = pairs(random.Random(9), 200, 90)
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(made)], "i int, a string, b string")
    want = [r[0] for r in rows.orderBy("i").select(F.levenshtein("a", "b")).collect()]
    assert distances([a for a, _ in made], [b for _, b in made]).tolist() == want


@pytest.mark.parametrize("length", range(60))
def test_segments_cover_a_text(length):
    for threshold in (0.0, 0.3, 0.5, 0.85, 0.99, 1.0):
        need, parts = segments(length, threshold)
        assert not parts or (sum(n for _, n in parts) == length and all(n > 0 for _, n in parts) and need >= 1)


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.7, 0.85, 0.95, 1.0])
def test_first_fit_equals_the_loop(threshold):
    rng = random.Random(int(threshold * 100))
    texts = []
    for _ in range(60):
        base = "".join(rng.choice("abc de\n") for _ in range(rng.choice([0, 1, 3, 10, 40, 90])))
        texts += [edited(rng, base, rng.randrange(1 + len(base) // 5), "abcé") for _ in range(4)]
    rng.shuffle(texts)
    index, seeds = SeedIndex(threshold), []
    for t in texts:
        want = next((k for k, s in enumerate(seeds) if max(len(s), len(t)) == 0 or 1.0 - table_distance(s, t) / max(len(s), len(t)) >= threshold), None)
        assert index.first(t) == want
        if want is None:
            seeds.append(t)
            index.add(t)
