"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with its borders marked) and itself, hashed into ``BUCKETS``; its vector is
the mean of theirs, so a misspelling never seen shares most of its vector with the word that it came from.  A text is
the mean of all its words, one that occurs n times with weight sqrt(n), and one linear softmax layer over it gives the probability of label 1,
which is the score.  Embeddings and layer are trained together by AdaGrad on documents.  A group lasso shrinks each
embedding towards zero at every step, so that the n-grams that tell nothing stay silent and don't drown the few that do
in a long text's mean.

As the layer is linear, a trained model is one number per bucket, so scoring needs a lookup per n-gram of the distinct
words of a slice of texts; n-grams are hashed in numpy over all words at once.

The sample is bounded in rows: ``POSITIVES`` and ``NEGATIVES`` labelled documents at most, by hash of the id, of those
that have a word, whatever their length.  Tasks turn each into its buckets and their shares, at most ``BUCKETS`` of them a
document, and the driver gets no texts.  Scoring reads whole texts of any length.

Defined results: null, empty and wordless texts have the share of toxic rows in the sample as score; where the
sample has one class or none, that share (0 without a sample) is everyone's score; of several labels of a
document the largest counts; rows that repeat a doc_id are scored row by row, and learned from together; a null id is
scored and never learned from; an empty table gives no rows; of documents only doc_id and text are read, of labels
doc_id and toxic.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframes.llm.common import bound_batches, held, held_out, kept_object, slices, stored_object, text_slices, written

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
DIM = 4
GRAMS = (3, 4, 5)
POSITIVES, NEGATIVES = 1000, 2000
EPOCHS = 16
AVERAGED = 6
BATCH = 64
RATE = 0.5
#: Shrinkage of an embedding's length per step, in steps of ``RATE``.
LASSO = 0.02
#: The mean of a text's words enters the layer this many times as large; else its few telling words were too quiet.
GAIN = 10.0
#: Initial embeddings are small: an n-gram that training hardly sees must not speak.
SPREAD = 0.01
#: A text's mean is taken with so many silent words besides its own, so that few words alone decide nothing.
SILENT = 16

WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and of the words themselves, word after word; and how many each word has."""
    flats, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), 1 << 15):
        flat, size = _gram_ids(words[at : at + (1 << 15)])
        flats.append(flat)
        sizes.append(size)
    return np.concatenate(flats), np.concatenate(sizes)


def _gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    stops = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    room = np.repeat(stops, lengths) - np.arange(len(points))  # characters up to the word's end
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in words), np.int32, len(words))
    buckets, owners = [whole], [np.arange(len(words), dtype=np.int32)]
    h = np.zeros(len(points), np.uint64)
    for k in range(max(GRAMS)):
        h[: len(h) - k] = (h[: len(h) - k] * _PRIME) ^ (points[k:] * _MULTIPLIER)
        h ^= h >> np.uint64(29)
        if k + 1 in GRAMS:
            at = np.flatnonzero(room > k)
            buckets.append(((h[at] * _MULTIPLIER) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owners, minlength=len(words))


class Model(NamedTuple):
    weights: np.ndarray  # a logit per bucket
    bias: float
    prior: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        flat, sizes = gram_ids(words)
        return np.add.reduceat(self.weights[flat].astype(np.float64), np.cumsum(sizes) - sizes) / sizes if len(words) else np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The softmax's probability of label 1 for each text."""
        number: dict[str, int] = {}
        docs = [{number.setdefault(w, len(number)): n for w, n in Counter(words_of(t)).items()} for t in texts]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        out = np.full(len(docs), self.prior)
        some = sizes > 0
        if some.any() and 0 < self.prior < 1:
            words = np.fromiter((w for d in docs for w in d), np.int64, int(sizes.sum()))
            weight = np.sqrt(np.fromiter((n for d in docs for n in d.values()), np.float64, len(words)))
            first = (np.cumsum(sizes) - sizes)[some]
            sums = np.add.reduceat(self.word_logits(list(number))[words] * weight, first)
            means = sums / (np.add.reduceat(weight, first) + SILENT)
            out[some] = 1 / (1 + np.exp(-np.clip(means + self.bias, -50, 50)))
        return out


def _rows(docs: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of each document and their shares in the mean of its words."""
    number: dict[str, int] = {}
    coded = [{number.setdefault(w, len(number)): n for w, n in Counter(words).items()} for words in docs]
    flat, sizes = gram_ids(list(number))
    first = np.cumsum(sizes) - sizes
    columns, shares = [], []
    for words in coded:
        if not words:
            columns.append(np.zeros(0, np.int32))
            shares.append(np.zeros(0, np.float32))
            continue
        distinct, weight = np.fromiter(words, np.int64, len(words)), np.sqrt(np.fromiter(words.values(), np.float64, len(words)))
        n = sizes[distinct]
        at = np.repeat(first[distinct] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        used, to = np.unique(flat[at], return_inverse=True)
        columns.append(used)
        shares.append((np.bincount(to, np.repeat(weight / n, n)) * (GAIN / (weight.sum() + SILENT))).astype(np.float32))
    return columns, shares


def _descend(columns: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Joint training; returns the logit per bucket and the bias, both as means over the last epochs."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-SPREAD, SPREAD, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.uniform(-1, 1, (DIM, 2)), np.zeros(2)
    seen, seen_layer, seen_bias = np.full((BUCKETS, 1), 1e-6, np.float32), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)
    # the rarer class counts more, by the root of how much rarer it is
    weight = np.where(y == 1, np.sqrt(0.5 / y.mean()), np.sqrt(0.5 / (1 - y.mean())))
    mean, mean_bias = np.zeros(BUCKETS), 0.0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            sizes = np.array([len(columns[r]) for r in rows])
            at, share = np.concatenate([columns[r] for r in rows]), np.concatenate([shares[r] for r in rows])
            x = np.add.reduceat(table[at] * share[:, None], np.cumsum(sizes) - sizes, axis=0)
            z = x @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows][:, None] / len(rows)
            grad_layer, grad_bias, grad_x = x.T @ p, p.sum(axis=0), p @ layer.T
            per = np.repeat(grad_x, sizes, axis=0) * share[:, None]
            step = np.stack([np.bincount(at, per[:, k], minlength=BUCKETS) for k in range(DIM)], axis=1).astype(np.float32)
            seen += (step**2).mean(axis=1, keepdims=True)
            table -= RATE * step / np.sqrt(seen)
            table *= np.maximum(0, 1 - LASSO * RATE / np.maximum(np.sqrt((table**2).sum(axis=1, keepdims=True)), 1e-9))
            seen_layer += grad_layer**2
            seen_bias += grad_bias**2
            layer -= RATE * 0.1 * grad_layer / np.sqrt(seen_layer)
            bias -= RATE * 0.1 * grad_bias / np.sqrt(seen_bias)
        if epoch >= EPOCHS - AVERAGED:
            mean += table @ (layer[:, 1] - layer[:, 0]) / AVERAGED
            mean_bias += (bias[1] - bias[0]) / AVERAGED
    return (mean * GAIN).astype(np.float32), float(mean_bias)


def train(texts: list[str | None], toxic: list[int]) -> Model:
    """A model of labelled texts; those without a word are left out."""
    docs = [(words, y) for words, y in ((words_of(t), y) for t, y in zip(texts, toxic, strict=True)) if words]
    return learned(*_rows([words for words, _ in docs]), [y for _, y in docs])


def learned(columns: list[np.ndarray], shares: list[np.ndarray], toxic: list[int]) -> Model:
    """A model of documents given as buckets and shares."""
    prior = float(np.mean(toxic)) if toxic else 0.0
    if prior in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), 0.0, prior)
    weights, bias = _descend(columns, shares, np.array(toxic))
    return Model(weights, bias, prior)


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(doc_id, toxic, buckets, shares) of the labelled documents to learn from, none of them held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(r"(?U)\w"))
    known = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(text.select("doc_id").distinct(), "doc_id", "left_semi")
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    some = known.filter("toxic = 1").orderBy(*by_hash).limit(positives).unionByName(known.filter("toxic = 0").orderBy(*by_hash).limit(negatives))
    # of rows that repeat an id one is learned from, so the sample stays within its bound
    ids = F.broadcast(written(some, "toxicity-sample"))  # at most positives + negatives rows
    whole = text.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def bags(batches):
        for batch in batches:
            for part in slices(batch):
                columns, shares = _rows([words_of(t) for t in part.column("text").to_pylist()])
                held = [pa.array([c.astype(kind).tobytes() for c in values], pa.binary()) for values, kind in ((columns, "<i4"), (shares, "<f4"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *held], names=["doc_id", "toxic", "buckets", "shares"])

    bound_batches(docs.sparkSession)
    return whole.mapInArrow(bags, "doc_id long, toxic int, buckets binary, shares binary")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that aren't held out; the sample is bounded."""
    rows = [r for r in sample(docs, labels).collect() if len(r.buckets)]
    rows.sort(key=lambda r: r.doc_id)
    return learned([np.frombuffer(r.buckets, "<i4") for r in rows], [np.frombuffer(r.shares, "<f4") for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    bound_batches(docs.sparkSession)
    path = stored_object(docs.sparkSession, "toxicity", model)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        with held(path, lambda: kept_object(path)) as model:
            return pd.Series(np.concatenate([np.zeros(0), *(model.scores(part) for part in text_slices(texts, rows=1024, size=1 << 20))]))

    rows = docs.select("doc_id", held_out().alias("held_out"), toxic(F.col("text").cast("string")).alias("score"))
    return rows.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
