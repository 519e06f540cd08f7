"""Ranked lexical search: exact top-k documents for a set of queries, by whole-number BM25.

The index is cut into shards of about ``SHARD_BYTES`` of text, none of which crosses a task.  In a shard documents are
numbered by doc_id; a term's postings are the gaps of those numbers and the term's occurrences, as variable-length bytes.
A shard's first row, which has no term, holds its documents' ids and lengths.  A search keeps only the postings of terms
that some query has, gives each the term's weight and its queries, and deals the shards to tasks.

In a shard a query's postings are merged document at a time by a heap of one cursor a term.  Each query keeps its k
best in a heap whose least entry has the lowest score and, of equal scores, the largest doc_id; it stays from shard to shard
of a task.  Terms whose largest shares together can't lift a document to that entry's score need no cursor: they are
looked up for the documents that the others reach, heaviest first, for as long as the entry can still be reached.  The
tasks' k best of a query are ranked once more.

Queries come in blocks of ``QUERY_BLOCK``, each a search of its own inside the same job, so that a task's heaps and a
posting's list of queries are bounded.

Defined results: a null text has no terms, and a query without terms no rows; rows that repeat a doc_id are documents of their
own and ranked apart, those without an id come last among equal scores; items that repeat an id, or have none, are
queries of their own; an empty table gives no rows; of all columns only doc_id and text (item_id and text) are read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeframes.llm.common import bound_batches, slices, written

SHARD_BYTES = 8 << 20
QUERY_BLOCK = 512
TOP = 10

# What separates terms, and the constants of the score.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SCALE, RISE, NORM = 1_000_000_000, 1000, 75
LAST_ID = (1 << 63) - 1

INDEX_SCHEMA = "shard long, term string, df long, tokens long, postings binary"
_QUERIES = "array<struct<item: bigint, item_id: bigint, times: bigint>>"
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as groups of seven bits, lowest first, all but the last marked; and how many bytes each takes."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        sizes += values >= np.uint64(1 << bits)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        some = sizes > k
        more = (sizes[some] > k + 1).astype(np.uint8) << 7
        out[starts[some] + k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, sizes


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, starts) if len(ends) else np.zeros(0, np.uint64)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of an Arrow column of texts, one after the other, and the place of the text that holds each."""
    column = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = (data.to_pybytes() if data else b"")[offsets[0] : offsets[-1]].translate(_TERM_BYTES)
    offsets = offsets - offsets[0]
    flat = np.frombuffer(raw, np.uint8)
    inside = flat != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]  # a term never crosses two texts
    starts = np.flatnonzero(begins)
    letters = np.concatenate(([0], np.cumsum(inside)))
    bounds = np.append(letters[starts], letters[-1]).astype(np.int64)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat[inside].tobytes())])
    return values, np.searchsorted(offsets, starts, "right") - 1


def shard_rows(number: int, ids: list, texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard, its documents first."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    codes, docs, seen, base = [], [], [], 0
    for some in texts:
        values, place = terms_of(some)
        coded = values.dictionary_encode()
        seen.append(coded.dictionary)
        codes.append((coded.indices.to_numpy().astype(np.int64), len(seen) - 1))
        docs.append(rank[place + base])
        base += len(some)
    words = pa.chunked_array(seen, pa.large_binary()).combine_chunks().dictionary_encode()
    starts = np.cumsum([0, *map(len, seen)])
    code = np.concatenate([words.indices.to_numpy()[starts[k] + c].astype(np.int64) for c, k in codes] or [np.zeros(0, np.int64)])
    doc = np.concatenate(docs or [np.zeros(0, np.int64)])
    lengths = np.bincount(doc, minlength=len(ids))
    head, _ = packed(np.array([x for i in order for x in (*_id_parts(ids[i]), int(lengths[rank[i]]))], np.uint64))
    yield _rows(number, pa.array([None], pa.string()), [int((lengths > 0).sum())], [len(doc)], [head.tobytes()])
    if not len(code):
        return
    key, tf = np.unique(code * len(ids) + doc, return_counts=True)
    code, doc = key // len(ids), key % len(ids)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    gaps = np.diff(doc, prepend=0)
    gaps[first] = doc[first]
    flat, sizes = packed(np.stack([gaps, tf], axis=1).ravel())
    ends = np.cumsum(sizes)[1::2]
    bounds = np.concatenate(([0], ends[np.append(first[1:], len(code)) - 1]))
    df, held, data = np.diff(np.append(first, len(code))), np.add.reduceat(tf, first), flat.tobytes()
    terms = pc.cast(pc.cast(words.dictionary, pa.large_string()), pa.string())
    for i in range(0, len(first), 65_536):
        j = min(i + 65_536, len(first))
        yield _rows(number, terms.slice(i, j - i), df[i:j], held[i:j], [data[a:b] for a, b in zip(bounds[i:j].tolist(), bounds[i + 1 : j + 1].tolist(), strict=True)])


def _id_parts(doc_id: int | None) -> tuple[int, int]:
    """Whether there is an id, and its sign and size as one number that is never negative."""
    return (0, 0) if doc_id is None else (1, doc_id * 2 if doc_id >= 0 else -doc_id * 2 - 1)


def _documents(head: bytes) -> tuple[list[int | None], np.ndarray]:
    """Ids and lengths of a shard's documents."""
    has, size, length = unpacked(head).reshape(-1, 3).T
    signed = np.where(size & np.uint64(1), -(size >> np.uint64(1)).astype(np.int64) - 1, (size >> np.uint64(1)).astype(np.int64))
    return [i if h else None for i, h in zip(signed.tolist(), has.tolist(), strict=True)], length.astype(np.int64)


def _rows(number: int, terms: pa.Array, df, tokens, postings: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(terms), number)), terms, pa.array(df, pa.int64()), pa.array(tokens, pa.int64()), pa.array(postings, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "df", "tokens", "postings"])


def build_index(docs: DataFrame) -> DataFrame:
    """The index as a written table."""

    def work(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for some in slices(batch, rows=1 << 16, size=SHARD_BYTES // 4):
                ids += some.column("doc_id").to_pylist()
                texts.append(some.column("text"))
                size += texts[-1].nbytes
                if size >= SHARD_BYTES:
                    yield from shard_rows(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield from shard_rows(number, ids, texts)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(work, INDEX_SCHEMA), "lexical-index", "zstd")


def query_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times) of every query; ``item`` numbers the rows."""
    numbered = written(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "lexical-items")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = numbered.select("item", "item_id", F.explode(F.split(low, SEPARATORS)).alias("term"))
    return words.filter(F.length("term") > 0).groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


class Search:
    """The k best documents of each query over the shards of one task."""

    def __init__(self, top: int):
        self.top = top
        self.best: dict[int, list[tuple[int, int, int | None]]] = {}

    def shard(self, doc_ids: list, lists: list[tuple[list[int], list[int], int]], queries: dict[int, list[tuple[int, int]]]) -> None:
        """``lists`` has documents, shares and largest share of each term, ``queries`` the (list, times) of each item."""
        for item, wanted in queries.items():
            self._one(doc_ids, self.best.setdefault(item, []), [(*lists[k][:2], lists[k][2] * times, times) for k, times in wanted])

    def _one(self, doc_ids: list, heap: list, terms: list) -> None:
        terms.sort(key=lambda t: t[2])
        below = [0]  # the most that the lightest terms give together
        for t in terms:
            below.append(below[-1] + t[2])
        floor = heap[0][0] if len(heap) == self.top else 0
        light = 0  # so many terms have no cursor

        def raise_floor() -> int:
            k = light
            while k < len(terms) and below[k + 1] < max(floor, 1):
                k += 1
            return k

        light = raise_floor()
        cursors = [(terms[k][0][0], k, 0) for k in range(light, len(terms))]
        heapq.heapify(cursors)
        while cursors:
            doc, score = cursors[0][0], 0
            while cursors and cursors[0][0] == doc:
                _, k, at = cursors[0]
                docs, shares, _, times = terms[k]
                if k < light:  # became light meanwhile: looked up below
                    heapq.heappop(cursors)
                    continue
                score += shares[at] * times
                if at + 1 < len(docs):
                    heapq.heapreplace(cursors, (docs[at + 1], k, at + 1))
                else:
                    heapq.heappop(cursors)
            k = light
            while k and score + below[k] >= floor:
                k -= 1
                docs, shares, _, times = terms[k]
                at = bisect_left(docs, doc)
                if at < len(docs) and docs[at] == doc:
                    score += shares[at] * times
            if k or score <= 0 or score < floor:
                continue
            doc_id = doc_ids[doc]
            entry = (score, -(LAST_ID if doc_id is None else doc_id), doc_id)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top and heap[0][0] > floor:
                floor = heap[0][0]
                light = raise_floor()


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item, built on a fresh index of ``docs``."""
    return search_index(build_index(docs), items, top)


def search_index(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    heads = index.filter(F.col("term").isNull())
    n_docs, n_tokens = heads.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    terms = written(query_terms(items), "lexical-queries")
    blocks = max(1, -(-terms.select("item").distinct().count() // QUERY_BLOCK))
    df = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    asked = terms.groupBy("term", block.alias("block")).agg(F.collect_list(F.struct("item", "item_id", "times")).alias("queries"))
    wanted = written(asked.join(df.select("term", weight.alias("weight")), "term"), "lexical-wanted")
    lists = index.join(wanted, "term").select("block", "shard", "weight", "queries", "postings")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    first = heads.select(every.alias("block"), "shard", F.lit(None).cast("long").alias("weight"), F.lit(None).cast(_QUERIES).alias("queries"), "postings")
    dealt = first.union(lists).repartition("block", "shard").sortWithinPartitions("block", "shard", F.col("weight").asc_nulls_first())

    def work(batches):
        for block in _blocks(_shards(batches)):
            found, ids = Search(top), {}
            for (doc_ids, lengths), rows in block:
                norm = 8 * (100 - NORM + NORM * lengths * n_docs // n_tokens)
                lists, queries = [], {}
                for weight, asked, postings in rows:
                    gaps, tf = unpacked(postings).astype(np.int64).reshape(-1, 2).T
                    docs = np.cumsum(gaps)
                    shares = weight * (SCALE * tf // (RISE * tf + norm[docs]))
                    for q in asked:
                        queries.setdefault(q["item"], []).append((len(lists), q["times"]))
                        ids[q["item"]] = q["item_id"]
                    lists.append((docs.tolist(), shares.tolist(), int(shares.max())))
                found.shard(doc_ids, lists, queries)
            out = [(item, ids[item], doc_id, score) for item, heap in found.best.items() for score, _, doc_id in heap]
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    bound_batches(index.sparkSession)
    best = dealt.mapInArrow(work, "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, documents, rows of terms) of every shard, whose head comes first."""
    key, head, rows = None, None, []
    for batch in batches:
        block, shard, weight, queries, postings = (batch.column(c) for c in range(5))
        for i in range(batch.num_rows):
            if weight[i].is_valid:
                rows.append((weight[i].as_py(), queries[i].as_py(), postings[i].as_py()))
                continue
            if key is not None:
                yield key, _documents(head), rows
            key, head, rows = block[i].as_py(), postings[i].as_py(), []
    if key is not None:
        yield key, _documents(head), rows


def _blocks(shards: Iterator[tuple]) -> Iterator[Iterator[tuple]]:
    for _, some in groupby(shards, key=lambda s: s[0]):
        yield (s[1:] for s in some)


ORACLE = r"""
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents WHERE text IS NOT NULL),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE text IS NOT NULL),
len AS (SELECT doc_id, count(*) AS n FROM term GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM len),
held AS (SELECT doc_id, t, count(*) AS tf FROM term WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t),
weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM corpus) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held GROUP BY t),
share AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS s
          FROM held JOIN weight USING (t) JOIN len USING (doc_id), corpus),
total AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM asked JOIN share USING (t) GROUP BY item_id, doc_id HAVING sum(s) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM total)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
