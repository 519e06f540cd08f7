"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text.  A text is parsed against it from left to
right into longest matches: a phrase ends where the automaton has no transition.  The language that needs the
fewest phrases per n / log2(n) characters, n being the size of its training text, wins.

Every letter is a symbol of its own, whatever the scripts: an automaton keeps only the transitions that it has, all
rows displaced into one array (``Automaton``), so its size is that of its training text and not of the alphabet.

Parsing runs in numpy over many blocks at once.  A text is cut into blocks of ``BLOCK`` symbols, each parsed
from the root, so that every character of a long text counts and a very long text costs no more per character
than a short one; a block's border ends a phrase for every language alike.

Letters are lower-cased; each run of other characters is one separator.  The training sample is bounded in rows:
``SAMPLE_DOCS`` whole documents over all languages, ``DOCS_EACH`` at most and one at least for each, by hash of the id;
texts over ``SAMPLE_CHARS`` characters are taken only where a language has too few others.

Defined results: null texts and texts without a letter are ``und`` with score 0; with nothing to learn from, all
are ``und``; equal counts go to the smaller language code; the score is a softmax share, between 0 and 1.  Rows that
repeat a doc_id are each identified, and of those in one language one is learned from; rows without an id are never
learned from; an empty table gives no rows; of all columns only doc_id, text and lang are read, and lang only to learn.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeframes.llm.common import bound_batches, held, held_out, kept_object, stored_object, text_slices

SAMPLE_DOCS = 256
DOCS_EACH = 32
SAMPLE_CHARS = 20_000
BLOCK = 1024
SHARPNESS = 12.0
#: The filter rejects documents without letters, and those whose score is lower than this; by default none is.
LEAST_SCORE = 0.0

SEPARATOR, OTHER = 0, 1


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        now = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in nexts[p]:
            nexts[p][s] = now
            p = link[p]
        if p >= 0:
            q = nexts[p][s]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[now] = copy
                while p >= 0 and nexts[p].get(s) == q:
                    nexts[p][s] = copy
                    p = link[p]
        last = now
    return nexts


class Automaton:
    """Transitions by row displacement: that of ``state`` by ``symbol`` is at ``base[state] + symbol`` if ``owner`` there is
    the state.  ``root`` has the root's, 0 for those it lacks."""

    def __init__(self, nexts: list[dict[int, int]], size: int):
        base, owner, target = [0] * len(nexts), [-1] * (4 * size), [0] * (4 * size)
        by_size = sorted((k for k, row in enumerate(nexts) if row), key=lambda k: -len(nexts[k]))
        several = sum(len(nexts[k]) > 1 for k in by_size)
        # rows of several transitions first, each where it fits behind the start of the one before; those of one then
        # fill what is free.  Places begin at ``size``, so no row's base is negative; a state without a row has base 0, where no
        # place is its own.
        free = size
        for n, state in enumerate(by_size):
            if n == several:
                free = size
            row = nexts[state]
            while owner[free] >= 0:
                free += 1
            at = free - min(row)
            while len(row) > 1 and any([owner[at + s] >= 0 for s in row]):
                at += 1
                if at + 2 * size >= len(owner):
                    owner += [-1] * len(owner)
                    target += [0] * len(target)
            base[state] = at
            for s, to in row.items():
                owner[at + s], target[at + s] = state, to
            free = at + min(row) + 1
            if free + 2 * size >= len(owner):
                owner += [-1] * len(owner)
                target += [0] * len(target)
        self.base = np.array(base, np.int32)
        self.owner, self.target = np.array(owner, np.int32), np.array(target, np.int32)
        self.root = np.zeros(size, np.int32)
        for s, to in nexts[0].items():
            self.root[s] = to

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase ends before the symbol."""
        at = self.base[state] + symbol
        ends = self.owner[at] != state
        return np.where(ends, self.root[symbol], self.target[at]), ends


class Model:
    """Languages, the symbol of each code point, and an automaton per language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        joined = {k: " ".join(texts[k]).lower() for k in self.langs}
        counts: dict[str, int] = {}
        for t in joined.values():
            for ch, n in Counter(t).items():
                if ch.isalpha():
                    counts[ch] = counts.get(ch, 0) + n
        letters = sorted(counts, key=lambda ch: (-counts[ch], ch))
        code = {ch: i + 2 for i, ch in enumerate(letters)}
        # a letter of no sample has no transition anywhere, so all such are one symbol; no letters lie beyond 0x34000,
        # and what does takes the last entry, a separator
        low = ((chr(c), chr(c).lower()[0]) for c in range(0x34000))
        self.symbols = np.fromiter((code.get(x, OTHER) if x.isalpha() or ch.isalpha() else SEPARATOR for ch, x in low), np.int32, 0x34000)
        self.automata, self.norms = [], []
        for k in self.langs:
            symbols = self.encode(joined[k])
            self.automata.append(Automaton(suffix_automaton(symbols.tolist()), len(letters) + 2))
            self.norms.append(float(np.log2(max(2, len(symbols)))))

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text; each run of separators is one, and none leads."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        s = self.symbols[np.minimum(points, len(self.symbols) - 1)]
        keep = s != SEPARATOR
        keep[1:] |= s[:-1] != SEPARATOR
        return s[keep]

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrase counts [document, language]."""
        sizes = np.array([len(d) for d in docs])
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(docs)), blocks)
        first = np.cumsum(blocks) - blocks
        lengths = np.minimum(BLOCK, sizes[owner] - (np.arange(len(owner)) - first[owner]) * BLOCK)
        out = np.zeros((len(docs), len(self.langs)))
        if not len(owner):
            return out
        flat = np.concatenate(docs)
        starts = (np.cumsum(sizes) - sizes)[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # blocks longer than t
        grid = [flat[starts[:m] + t] for t, m in enumerate(alive)]
        for k, automaton in enumerate(self.automata):
            state, count = np.zeros(len(starts), np.int32), np.ones(len(starts), np.int64)
            for m, column in zip(alive, grid, strict=True):
                state[:m], ends = automaton.step(state[:m], column)
                count[:m] += ends
            out[:, k] = np.bincount(owner[order], weights=count, minlength=len(docs))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        docs = [self.encode(t) if t else np.zeros(0, np.int32) for t in texts]
        lettered = np.array([bool((d != SEPARATOR).any()) for d in docs], bool)
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        some = np.flatnonzero(lettered)
        if not len(some) or not self.langs:
            return langs, scores
        counts = self.phrases([docs[i] for i in some])
        rate = counts * np.array(self.norms) / np.array([len(docs[i]) for i in some])[:, None]
        best = rate.argmin(axis=1)
        share = np.exp(-SHARPNESS * (rate / np.maximum(rate.min(axis=1, keepdims=True), 1e-9) - 1))
        share = share[np.arange(len(some)), best] / share.sum(axis=1)
        for i, b, s in zip(some, best, share, strict=True):
            langs[i], scores[i] = self.langs[b], s
        return langs, scores


def fit(docs: DataFrame) -> Model:
    """Learn from rows with a language whose id isn't held out."""
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("t"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("t").isNotNull() & ~held_out())
    by_hash = Window.partitionBy("lang").orderBy(F.col("long"), F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang", (F.length("t") > SAMPLE_CHARS).alias("long")).distinct()
    chosen = ids.withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= DOCS_EACH).select("doc_id", "lang", "k").collect()
    each = min(DOCS_EACH, max(1, SAMPLE_DOCS // max(1, len({r.lang for r in chosen}))))
    wanted = [r.doc_id for r in chosen if r.k <= each]
    texts: dict[str, list[str]] = {}
    if wanted:
        found = rows.filter(F.col("doc_id").isin(wanted)).groupBy("lang", "doc_id").agg(F.min("t").alias("t")).collect()
        for r in sorted(found, key=lambda r: r.doc_id):
            texts.setdefault(r.lang, []).append(r.t)
    return Model(texts)


def predictor(spark: SparkSession, model: Model):
    """A pandas UDF text -> struct(lang_pred, score); tasks read the model from the shared folder."""
    bound_batches(spark)
    path = stored_object(spark, "langid", model)

    @F.pandas_udf("lang_pred string, score double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], [np.zeros(0)]
        with held(path, lambda: kept_object(path)) as model:
            for part in text_slices(texts):
                found, share = model.predict(part)
                langs += found
                scores.append(share)
        return pd.DataFrame({"lang_pred": langs, "score": np.concatenate(scores)})

    return identify


def _text() -> Column:
    return F.col("text").cast("string")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    udf = predictor(docs.sparkSession, fit(docs))
    return docs.select("doc_id", held_out().alias("held_out"), udf(_text()).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows in some learned language with at least that score; ``lang`` becomes that language, and nothing else about them
    changes."""
    udf = predictor(docs.sparkSession, fit(docs)).asNondeterministic()  # evaluated once, below the filter
    rows = docs.select(F.struct("*").alias("row"), udf(_text()).alias("p")).filter((F.col("p.lang_pred") != "und") & (F.col("p.score") >= least_score))
    told = lambda c: F.col("p.lang_pred").cast(docs.schema[c].dataType) if c.lower() == "lang" else F.col("row").getField(c)
    return rows.select(*(told(c).alias(c) for c in docs.columns))
