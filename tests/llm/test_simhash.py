import random
import re

import numpy as np
import pytest
import xxhash

from codeframes.llm import simhash

from .helpers import empty_docs, odd_docs, odd_rows


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least[find(i)] for i in range(len(ids))]


def test_against_brute_force(spark):
    rows = odd_rows()
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_components([r[0] for r in rows], fps), strict=True))
    assert sorted(tuple(r) for r in simhash.near_duplicates(odd_docs(spark)).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_no_documents(spark):
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def near_fps(n, seed):
    """Dense groups around few centres, and strays."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        f = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 9)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_connect_what_brute_force_connects(spark, seed):
    fps = near_fps(1500, seed)
    a = np.array(fps, np.uint64)
    classes = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    links = {(r.node): r.root for r in simhash.components(simhash.edges(classes)).collect()}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 4):
            parent[find(i)] = find(int(j))
    got = {}
    for i, f in enumerate(fps):
        got.setdefault(links.get(simhash.signed(f), simhash.signed(f)), set()).add(i)
    want = {}
    for i in range(len(fps)):
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_chain_filter_never_drops_a_link():
    rng = np.random.default_rng(0)
    diffs = np.zeros(20000, np.uint64)
    for _ in range(4):
        diffs |= np.uint64(1) << rng.integers(0, 64, len(diffs)).astype(np.uint64)
    assert simhash.chains_hold(diffs).all()
    assert not simhash.chains_hold(rng.integers(0, 1 << 63, 1000).astype(np.uint64)).all()


def test_long_chain_of_links_is_one_component(spark):
    pairs = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    assert {r.root for r in simhash.components(pairs).collect()} == {0}


def test_keep_one(spark):
    docs = odd_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    rows = odd_rows()
    want = sorted(set(plain_components([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows])))
    assert ids == want


def test_keep_one_keeps_what_is_no_duplicate(spark):
    from .helpers import sentence

    rng = random.Random(21)
    a, b, c, d, e = (sentence(rng, 80) for _ in range(5))
    rows = [(None, a, "x"), (None, b, "x"), (None, a, "y"), (3, c, "x"), (3, d, "x"), (3, c, "z"), (4, e, "x"), (5, e + " ", "x"), (6, None, "x"), (7, "", "x"), (None, e, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (3, c), (3, d), (4, e), (6, None)], key=str)
    again = [tuple(r) for r in simhash.keep_one(docs.repartition(3)).collect()]
    assert sorted(again, key=str) == sorted(map(tuple, simhash.keep_one(docs).collect()), key=str)
    ids = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert (None, None) in ids and (None, 4) in ids and (7, 6) in ids and (3, 3) in ids


def test_a_very_long_text():
    text = " ".join(f"w{i % 4999}" for i in range(200_000))
    flat = np.array(simhash.shingle_hashes(text.encode()), np.uint64)
    assert int(simhash.fold(flat, np.array([len(flat)]))[0]) == plain_fingerprint(text)


def test_a_hub_with_many_neighbours(spark):
    pairs = spark.createDataFrame([(i, 5) for i in range(6, 4000)] + [(5, -3), (9000, 9001)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(pairs).collect()} == {**{i: -3 for i in range(5, 4000)}, 9001: 9000}
