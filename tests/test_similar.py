"""The similarity join against all pairs."""

import random

import pytest

from codeframes.operators import similar
from tests.test_distance import edited, table_distance

LETTERS = "abcdé \n"


def texts(seed, n=40):
    rng = random.Random(seed)
    made = ["", "a", "ab", "abc", "abcd", "abce", "aaaaaa", "aaaaab"]
    for _ in range(n):
        base = "".join(rng.choice(LETTERS) for _ in range(rng.choice([3, 8, 14, 30, 60, 150])))
        made += [base, edited(rng, base, 1 + len(base) // 10, LETTERS), edited(rng, base, 1 + len(base) // 6, LETTERS)]
    return made + made[:12] + ["    x = 1\n" * 8, "    x = 2\n" * 8, "    x = 1\n" * 7 + "y"]


@pytest.mark.parametrize("threshold", [0.75, 0.8, 0.85, 0.95, 1.0])
def test_links_are_those_of_all_pairs(spark, threshold):
    made = texts(int(threshold * 100))
    rows = [(i, t) for i, t in enumerate(made)] + [(3, None), (None, "no key"), (None, "no kez")]
    got = similar.similarity_join(spark.createDataFrame(rows, "id int, text string").repartition(3), "id", "text", threshold)
    bodies = [t or "" for _, t in rows]
    distinct = sorted(set(bodies))
    least = {t: min((i for (i, x), b in zip(rows, bodies, strict=True) if b == t and i is not None), default=None) for t in distinct}
    alike = lambda a, b: 1.0 - table_distance(a, b) / max(len(a), len(b)) >= threshold
    count = {a: sum(a != b and abs(len(a) - len(b)) <= max(len(a), len(b)) * (1 - threshold) + 1 and alike(a, b) for b in distinct) for a in distinct}
    want = sorted(((i, least[b], count[b]) for (i, _), b in zip(rows, bodies, strict=True)), key=repr)
    assert sorted((tuple(r) for r in got.select("id", "class_id", "n_links").collect()), key=repr) == want
    assert threshold in (0.95, 1.0) or sum(count.values()) > 20


def test_empty_and_bad_thresholds(spark):
    empty = spark.createDataFrame([], "id int, text string")
    assert similar.similarity_join(empty, "id", "text", 0.8).count() == 0
    with pytest.raises(ValueError):
        similar.similarity_join(empty, "id", "text", 0.5)
