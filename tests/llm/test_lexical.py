"""Op 12 against a loop over all documents and queries."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from codeframes.llm import lexical
from tests.llm.helpers import DOCS, empty_docs, odd_docs, odd_rows, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, top=10):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, c in docs:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(scored[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(n * 3) - n, sentence(rng, rng.choice([1, 3, 20, 200])), None, None, 0) for _ in range(n)]


def items_of(rows, seed):
    rng = random.Random(seed)
    some = [(k, " ".join(rng.sample((r[1] or "x").split() or ["x"], 1) * 2 + (r[1] or "").split()[:15])) for k, r in enumerate(rng.sample(rows, 15))]
    return some + [(3, some[0][1]), (None, some[1][1]), (90, None), (91, ""), (92, "nowhere-to-be-found 0000"), (93, "É é BA ba ba. Do_do")]


def test_equals_the_loop_over_many_shards(spark, monkeypatch):
    rows = odd_rows() + corpus(1, 400) + [(None, "ba do ki"), (None, "ba do ki")][:0] + [(None, "ba do ki lu", None, None, 0)] * 2
    items = items_of(rows, 2)
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    assert got(lexical.search(docs, spark.createDataFrame(items, ITEMS))) == brute(rows, items)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 4)
    rows = corpus(3, 120)
    items = items_of(rows, 4)
    assert got(lexical.search(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), 3)) == brute(rows, items, 3)


def test_pruning_keeps_ties_and_exact_scores():
    """The merge with light terms looked up equals plain sums, whatever the shares are."""
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 60)
        lists = []
        for _ in range(rng.randint(1, 9)):
            docs = sorted(rng.sample(range(n), rng.randint(1, n)))
            shares = [rng.choice([0, 1, 2, 5, 50]) for _ in docs]
            lists.append((docs, shares, max(shares)))
        wanted = [(k, rng.randint(1, 3)) for k in range(len(lists))]
        search = lexical.Search(4)
        half = n // 2
        for lo, hi in ((half, n), (0, half)):  # shards in any order
            part = [([d - lo for d in ds if lo <= d < hi], [s for d, s in zip(ds, ss, strict=True) if lo <= d < hi]) for ds, ss, _ in lists]
            kept = [k for k, p in enumerate(part) if p[0]]
            if kept:
                search.shard(list(range(lo, hi)), [(*part[k], max(part[k][1])) for k in kept], {7: [(kept.index(k), t) for k, t in wanted if k in kept]})
        total = Counter()
        for k, t in wanted:
            for d, s in zip(*lists[k][:2], strict=True):
                total[d] += s * t
        expect = sorted(((-s, d) for d, s in total.items() if s > 0))[:4]
        assert sorted((-s, d) for s, _, d in search.best.get(7, [])) == expect


def test_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**62, 2**64 - 1], np.uint64)
    data, sizes = lexical.packed(values)
    assert lexical.unpacked(data.tobytes()).tolist() == values.tolist() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 5, 9, 10]
    assert lexical.unpacked(b"").tolist() == []


def test_terms_do_not_cross_texts():
    values, place = lexical.terms_of(pa.array(["aB", "cd-Ef", None, "", "é9_x"])[1:])
    assert [v.decode() for v in values.to_pylist()] == ["cd", "ef", "é9", "x"] and place.tolist() == [0, 0, 3, 3]


def test_odd_columns_and_empty(spark):
    items = spark.createDataFrame([(1, "ba do"), (2, "word")], ITEMS)
    assert lexical.search(odd_docs(spark), items).count() > 0
    assert lexical.search(empty_docs(spark), items).count() == 0
    assert lexical.search(odd_docs(spark), items.limit(0)).count() == 0
