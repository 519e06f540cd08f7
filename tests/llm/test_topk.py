import math
import random

import numpy as np
import pytest

from codeframes.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v int, score string"


def plain(rows):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:20]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df.repartition(3)).collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1500)]
    rows += [(2000 + i, rows[i % 5][1]) for i in range(60)]  # ties
    rows += [(4000, None), (4020, []), (4040, [1.0, None]), (4060, [float("nan"), 1.0]), (4080, [float("inf")] * 8), (4100, [3.0]), (None, [1.0] * 8), (4120, [0.0] * 8)]
    assert run(spark, rows) == plain(rows)


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 2.0]), (3, [1.0, 1.0]), (20, [0.5, -0.5])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []


def searched(x, queries, floors=-np.inf):
    """The products that a search computed, after holding its result against the plain one."""
    ids, pivots = np.arange(len(x)), topk.pick_pivots(x[:500])
    part = topk.Part(ids, x, pivots)
    found, got, scores = part.search(queries, x[queries], topk.distances(x[queries], pivots), np.full(len(queries), floors))
    for k, q in enumerate(queries):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        assert got[found == k].tolist() == order and scores[found == k].tolist() == s[order].tolist()
    return part.products / (len(queries) * len(x))


@pytest.mark.parametrize("width", [6, 64])
def test_bounds_save_evaluations_and_lose_nothing(width):
    rng = np.random.default_rng(0)
    centres = rng.integers(-60, 60, (20, width))
    x = (centres[rng.integers(0, 20, 4000)] + rng.integers(-3, 4, (4000, width))).astype(float)
    assert searched(x, np.arange(0, 4000, 200)) < 0.7


def test_where_bounds_are_worth_nothing_all_pairs_are_evaluated():
    x = np.floor(64 * np.random.default_rng(0).normal(size=(4000, 64)))
    assert searched(x, np.arange(0, 4000, 200)) == 1.0


def test_queries_that_repeat_an_id(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(100)] + [(20, [1.0, 0.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)
    got = [r for r in topk.search(df).collect() if r.query_id == 20]
    lists = {}
    for r in got:
        lists.setdefault(r.query_key, []).append((r["rank"], r.vec_id, r.score))
    want = []
    for v in {tuple(v) for i, v in rows if i == 20}:
        q = [math.floor(64 * float(np.float32(x))) for x in v]
        scores = sorted((-sum(a * math.floor(64 * float(np.float32(b))) for a, b in zip(q, w, strict=True)), i) for i, w in rows if i != 20)[:20]
        want.append([(k + 1, i, -s) for k, (s, i) in enumerate(scores)])
    assert sorted(map(sorted, lists.values())) == sorted(want)


def test_vectors_of_very_different_lengths(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([1, 2, 3, 5, 17, 64, 65, 300]))]) for i in range(400)]
    assert run(spark, rows) == plain(rows)


def test_a_vector_of_a_million_components(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(i % 7), 1.0]) for i in range(1, 300)]
    short = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    long = spark.range(1).select(F.lit(300).cast("long").alias("vec_id"), F.array_repeat(F.lit(2.0).cast("float"), 1_000_000).alias("embedding"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(short.union(long)).collect())
    assert got == plain(rows + [(300, [2.0, 2.0])])  # what it has beyond two components meets no other vector


def test_components_beyond_long_lose_no_row(spark):
    rows = [(0, [1e30, 0.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [0.5, 1.0])]
    got = [(r["rank"], r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(1, 1, 2**63 - 1), (2, 3, 2**63 - 1), (3, 2, -(2**63))]


def peak_of_parts(rows):
    """Peak bytes while the parts of one partition of ``rows`` vectors are made, one at a time, and their rows."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)

    def batches():
        for lo in range(0, rows, 5000):
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, 5000 * 64 + 1, 64, dtype=np.int32)), pa.array(np.floor(rng.normal(size=5000 * 64) * 64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + 5000)), v], names=["vec_id", "v"])

    pivots = np.zeros((64, 64))
    tracemalloc.start()
    seen = sum(len(part.ids) for part in topk.parts_of(batches(), pivots, 8 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return seen, peak


def test_memory_stays_flat_when_a_partition_grows():
    (few, small), (many, large) = peak_of_parts(20_000), peak_of_parts(200_000)
    assert (few, many) == (20_000, 200_000) and large < 1.2 * small
