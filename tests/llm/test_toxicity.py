import random
import zlib

import numpy as np

from codeframes.llm import toxicity

from .helpers import empty_docs, odd_docs, sentence

BAD = ("scoundrel", "blockhead", "nitwit", "dunderhead")


def corpus(n=3000):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words, toxic = sentence(rng, rng.choice([20, 60, 250])).split(), int(i % 8 == 0)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w = list(rng.choice(BAD))
                k = rng.randrange(2, len(w) - 1)
                if rng.random() < 0.5:
                    w.insert(k, w[k])  # misspelt
                words.insert(rng.randrange(len(words)), "".join(w))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, text int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and all(got[i].held_out for i, _ in held)
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_unseen_misspelling_is_near_its_word():
    rows = corpus()
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    seen = {w for _, t, _ in rows for w in toxicity.words_of(t)}
    new = [w for w in ("scoundrrrel", "blockheadd", "nittwitt", "dunderheads") if w not in seen]
    assert new and min(model.word_logits(new)) > np.quantile(model.word_logits(sorted(seen)), 0.95)


def test_odd_inputs(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1), (7, 0), (7, 0), (None, 1), (5, None), (101, 0), (102, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty_docs(spark), model).count() == 0
    nothing = toxicity.fit(docs, labels.filter("false"))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}
    one = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, one).collect()} == {0.0}


def plain_score(model, text):
    """The averaged bag under the softmax, gram by gram and word by word."""
    mask, count = (1 << 64) - 1, {}
    for w in toxicity.WORD.findall((text or "").lower()):
        count[w] = count.get(w, 0) + 1
    if not count:
        return model.prior
    total = weights = 0.0
    for w, n in count.items():
        marked = [ord(c) for c in f"<{w}>"]
        buckets = [zlib.crc32(w.encode()) % toxicity.BUCKETS]
        for size in toxicity.GRAMS:
            for i in range(len(marked) - size + 1):
                h = 0
                for c in marked[i : i + size]:
                    h = ((h * 0x100000001B3) & mask) ^ ((c * 0x9E3779B97F4A7C15) & mask)
                    h ^= h >> 29
                buckets.append(((h * 0x9E3779B97F4A7C15) & mask) >> (64 - toxicity.BUCKET_BITS))
        total += n**0.5 * float(np.mean(model.weights[buckets].astype(float)))
        weights += n**0.5
    return 1 / (1 + np.exp(-(total / (weights + toxicity.SILENT) + model.bias)))


def test_scores_are_those_of_a_plain_model():
    rows = corpus(600)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    texts = [rows[0][1], rows[1][1], "scoundrel", "a", "", "é漢字 \U0001f600 é é", "x" * 3000, "blockhead " * 500, "word scoundrell " + "y" * 70]
    assert np.allclose(model.scores(texts), [plain_score(model, t) for t in texts], atol=1e-6)
    long = "q" * 50 + "blockhead" + "z" * 50  # what stands inside a long word counts
    assert model.word_logits([long])[0] != model.word_logits(["q" * 50 + "blockhexd" + "z" * 50])[0]


def test_all_of_a_long_text_counts():
    rows = corpus(600)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    clean = sentence(random.Random(9), 30_000)
    bad = " ".join(clean.split()[:25_000]) + " scoundrel blockhead nitwit dunderhead" * 1500
    scores = model.scores([clean, bad])
    assert scores[1] > 0.5 > scores[0]


def test_empty_text_has_the_prior(spark):
    rows = corpus(200)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    got = toxicity.score(spark.createDataFrame([(1, ""), (2, None), (3, "?!")], "doc_id long, text string"), model).collect()
    assert {round(r.score, 9) for r in got} == {round(model.prior, 9)}


def test_long_documents_are_learned_from(spark):
    """All toxic documents are long and all others short; null and wordless ones of the sample are replaced."""
    rng = random.Random(6)
    texts = [(i, sentence(rng, 9_000) + " scoundrel blockhead nitwit" * 300, 1) for i in range(1, 31)] + [(i, sentence(rng, 40), 0) for i in range(31, 61)]
    texts += [(i, [None, "", "?!"][i % 3], i % 2) for i in range(61, 121)]
    assert min(len(t) for _, t, y in texts[:30]) > 40_000
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    learned = [i for i, *_ in texts if i <= 60 and zlib.crc32(str(i).encode()) % 5]
    assert sorted(r.doc_id for r in toxicity.sample(docs, labels).collect()) == learned
    few = toxicity.sample(docs, labels, 5, 7).collect()
    assert sorted(r.toxic for r in few) == [0] * 7 + [1] * 5 and all(len(r.buckets) for r in few)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs.filter("text IS NOT NULL"), model).collect()}
    assert all(got[i].predicted == y for i, _, y in texts[:60])


def test_rows_equal_the_plain_model(spark):
    """``fit`` and ``score`` over tables against training and scoring in a loop."""
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    learn = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    assert abs(model.prior - np.mean([y for _, y in learn])) < 1e-12
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.allclose([got[i] for i, *_ in rows], [plain_score(model, t) for _, t, _ in rows], atol=1e-6)
