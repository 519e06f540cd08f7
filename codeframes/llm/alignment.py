"""Alignment of two tokenizers over the same texts, and how often each pair of their tokens is linked in the corpus.

Every text is encoded by a byte-level vocabulary A (with a space before it) and a piece vocabulary B (which adds that
space itself).  In each Arrow partition DuckDB holds the tokens as interval tables over byte offsets: an ASOF join
finds the B token at or before the start of every A token, a running window sum over the starts they share numbers
the groups, a range join puts the B tokens into the groups' intervals, and tokens of one group are linked, equal ids of a
group counted before they meet.  Groups never cross an offset at which tokens of both sides end, so blocks of
``BLOCK_TOKENS`` tokens, cut there, are aligned one by one, however long a text is.

Tokens of both sides end before a space that follows a character other than white space, around a line break
between such characters, and between a letter and a mark: A's pattern ends a match there, and no piece of B goes across
(checked when B is loaded; else a text is one chunk).  Texts are cut there, and a chunk goes through tokenizers and
DuckDB once while a bounded cache holds it.

A partition writes one row per slice of documents: their numbers, the distinct id pairs of the slice with the
documents that hold each, and the links of each document as places in that list.  Counts are merged per task before
they are shuffled; slices then ask for the counts of their own pairs, once a slice however many documents hold them.

Defined results: a text that is null, empty, or not given back byte by byte by either vocabulary has no tokens: zeros and
an empty digest, and no part in the counts; rows that repeat a doc_id, or have none, are documents of their own;
strings of special tokens are plain text; an empty table gives no rows; of all columns only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframes.llm.common import bound_batches, held, slices, written
from codeframes.llm.pieces import GLUE, WHITE, Cut, PieceEncoder, byte_level_encoder, gathered, led_pieces

SLICE_BYTES = 1 << 20
BLOCK_TOKENS = 1 << 18
#: Distinct pairs that a task merges before it hands their counts on.
MERGE_PAIRS = 1 << 21
DUCKDB_MEMORY = "512MB"
#: Bytes of one of the two generations of aligned chunks that a worker keeps.
CHUNK_BYTES = 32 << 20
_SPACE = "\u2581"
_CUT = re.compile(f"(?<=[^{WHITE}]) ")
_HEAD = 16

SLICE_SCHEMA = (
    "slice long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "sizes array<int>, places binary, times binary, pairs binary, holders binary"
)
_ARRAYS = ("doc_ids", "n_a", "n_b", "n_groups", "n_links")

_GROUPED_A = """
CREATE OR REPLACE TEMP TABLE grouped_a AS
SELECT a.doc, a.id, a.s, a.e, sum(CASE WHEN a.s = b.s THEN 1 ELSE 0 END) OVER (ORDER BY a.s ROWS UNBOUNDED PRECEDING) AS grp
FROM tokens_a a ASOF JOIN tokens_b b ON a.s >= b.s"""
_GROUPED_B = """
CREATE OR REPLACE TEMP TABLE grouped_b AS
SELECT b.id, b.s, g.grp FROM tokens_b b
JOIN (SELECT grp, min(s) AS lo, max(e) AS hi FROM grouped_a GROUP BY grp) g ON b.s >= g.lo AND b.e <= g.hi"""
_LINKS = """
SELECT doc, a, b, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT x.doc, x.id AS a, y.id AS b, x.n * y.n AS n
  FROM (SELECT doc, grp, id, count(*) AS n FROM grouped_a GROUP BY ALL) x
  JOIN (SELECT grp, id, count(*) AS n FROM grouped_b GROUP BY ALL) y USING (grp)) GROUP BY ALL"""


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the
    others in their order for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Bytes(NamedTuple):
    """The bytes of a vocabulary's tokens, end to end, and the length of each."""

    flat: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Bytes:
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens)))


class Aligner:
    """Both tokenizers, a DuckDB connection, and a cache of aligned chunks, kept by a worker from slice to slice."""

    def __init__(self, a_path: str, b_path: str):
        import duckdb
        import sentencepiece

        self.encoder = byte_level_encoder(a_path)
        self.encoder.specials = {}  # strings of special tokens are plain text here
        from tokenizers import Tokenizer

        vocabulary, char = Tokenizer.from_file(a_path).get_vocab(), byte_of_char()
        names = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            names[i] = token
        self.a = Bytes.of([bytes(char[c] for c in n) if all(c in char for c in n) else n.encode() for n in names])
        self.b_model = model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.b = Bytes.of([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)])
        # what the cuts below rest on; two tokens stand before whatever follows a line break
        crossed = lambda a, b: (b == _SPACE and a != _SPACE) or "\n" in (a, b) or (a.isalpha() and b in ".,;:!?")
        self.cuts = not any(crossed(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)) and len(model.encode("\n")) == 2
        # an id behind each separator: none, next of its side, first of B, first of a group
        self.width = max(len(self.a.sizes), len(self.b.sizes))
        self.words = pa.array([sep + str(i) for sep in ("", ",", "|", ";") for i in range(self.width)])
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": "", "preserve_insertion_order": False})
        self.chunks = PieceEncoder(True, self.align_chunks, CHUNK_BYTES)
        self.encoder.limit = CHUNK_BYTES // 4

    def cut(self, texts: pa.Array) -> Cut:
        """The chunks of texts, of which the first has a space before it."""
        odd = pc.match_substring_regex(texts, f"(^|[{WHITE}]) |{GLUE}").to_numpy(zero_copy_only=False)
        if not self.cuts:
            odd[:] = True
        plain = np.flatnonzero(~odd)
        cut = led_pieces(texts.take(pa.array(plain)))
        number = {p: i for i, p in enumerate(cut.pieces)}
        index, runs = cut.index, [None] * len(texts)
        firsts, back = np.unique(index[cut.bounds[:-1]], return_inverse=True)
        index[cut.bounds[:-1]] = np.array([number.setdefault(" " + cut.pieces[k], len(number)) for k in firsts], np.int32)[back]
        for k, i in enumerate(plain.tolist()):
            runs[i] = index[cut.bounds[k] : cut.bounds[k + 1]]
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py()
            found = _CUT.split(text) if self.cuts else [text]
            runs[i] = np.fromiter((number.setdefault(" " + p, len(number)) for p in found), np.int32, len(found))
        # only texts begin with the empty piece, and these have a space before it now
        return Cut([p or " " for p in number], np.concatenate(runs), np.concatenate(([0], np.cumsum([len(r) for r in runs]))))

    def aligned(self, texts: pa.Array) -> dict[str, list]:
        """The columns of a slice, without its number and ids."""
        n, plain = len(texts), pc.fill_null(texts, "")
        cut = self.cut(plain)
        values = self.chunks.look_up(cut.pieces)
        heads = np.frombuffer(b"".join([v[:_HEAD] for v in values]), "<i4").reshape(-1, 4).astype(np.int64)
        pairs = [v[_HEAD : _HEAD + 16 * k] for v, k in zip(values, heads[:, 3].tolist(), strict=True)]
        written_out = pa.array([v[_HEAD + 16 * k :] for v, k in zip(values, heads[:, 3].tolist(), strict=True)], pa.binary())
        places = np.diff(cut.bounds)
        doc = np.repeat(np.arange(n), places)
        lost = np.bincount(doc, heads[cut.index, 0] < 0, n) > 0
        lost |= pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
        sums = [np.where(lost, 0, np.diff(np.concatenate(([0], np.cumsum(heads[cut.index, k])))[cut.bounds])) for k in range(3)]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut.bounds.astype(np.int32)), written_out.take(pa.array(cut.index))), b";")
        digests = ["" if gone else hashlib.sha256(text.as_buffer()).hexdigest() for gone, text in zip(lost.tolist(), joined, strict=True)]
        # each document's distinct chunks and their times, then their links
        held_by, times = np.unique((doc * len(values) + cut.index)[~lost[doc]], return_counts=True)
        doc, chunk = held_by // len(values), held_by % len(values)
        sizes, flat = heads[:, 3], np.frombuffer(b"".join(pairs), "<i8").reshape(-1, 2)
        at, _ = gathered(chunk, sizes, np.arange(len(flat)))
        doc, n_links = np.repeat(doc, sizes[chunk]), flat[at, 1] * np.repeat(times, sizes[chunk])
        keys, place = np.unique(flat[at, 0], return_inverse=True)
        rows, row = np.unique(doc * max(len(keys), 1) + place, return_inverse=True)
        doc, place, n_links = rows // max(len(keys), 1), rows % max(len(keys), 1), _sums(row, n_links, len(rows))
        return {
            "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": _sums(doc, n_links, n), "digests": digests,
            "sizes": np.bincount(doc, minlength=n).astype(np.int32), "places": place.astype("<i4").tobytes(), "times": n_links.astype("<i8").tobytes(),
            "pairs": keys.astype("<i8").tobytes(), "holders": np.bincount(place, minlength=len(keys)).astype("<i8").tobytes(),
        }

    def align_chunks(self, chunks: list[str]) -> list[bytes]:
        """For each chunk the numbers of its tokens, groups and pairs, its pairs with their links, and its written groups; -1
        tokens where a vocabulary doesn't give the chunk back."""
        out: list[bytes] = []
        total, some = 0, []
        for c in chunks:
            some.append(c)
            total += len(c)
            if total > SLICE_BYTES:
                out += self._align(some)
                total, some = 0, []
        return out + (self._align(some) if some else [])

    def _align(self, chunks: list[str]) -> list[bytes]:
        n, raw = len(chunks), [c.encode() for c in chunks]
        ids_a = self.encoder.encode(pa.array(chunks))
        if self.cuts:  # B puts its space before the line break, and chunks stand as they are
            ids_b = [ids[2:] for ids in self.b_model.encode(["\n" + c for c in chunks], num_threads=1)]
        else:
            ids_b = self.b_model.encode([c[1:] for c in chunks], num_threads=1)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, n) for ids in (ids_a, ids_b))
        a, b = np.concatenate(ids_a).astype(np.int64), np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        whole, same = b"".join(raw), np.ones(n, bool)
        for ids, count, v in ((a, n_a, self.a), (b, n_b, self.b)):
            if gathered(ids, v.sizes, v.flat)[0].tobytes() != whole:
                bounds = np.concatenate(([0], np.cumsum(count)))
                same &= [gathered(ids[i:j], v.sizes, v.flat)[0].tobytes() == r for i, j, r in zip(bounds[:-1].tolist(), bounds[1:].tolist(), raw, strict=True)]
        chunk_a, chunk_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        a, chunk_a, b, chunk_b = a[same[chunk_a]], chunk_a[same[chunk_a]], b[same[chunk_b]], chunk_b[same[chunk_b]]
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        groups, text, links = np.zeros(n, np.int64), [[] for _ in range(n)], []
        for (i, k), (j, m) in self._blocks(ends_a, ends_b):
            block_a = (chunk_a[i:k], a[i:k], ends_a[i:k] - self.a.sizes[a[i:k]], ends_a[i:k])
            block_b = (chunk_b[j:m], b[j:m], ends_b[j:m] - self.b.sizes[b[j:m]], ends_b[j:m])
            grp_a, grp_b, found = self._block(block_a, block_b)
            links.append(found)
            np.add.at(groups, block_a[0][np.flatnonzero(np.diff(grp_a, prepend=grp_a[0] - 1))], 1)
            self._write(block_a[:2], block_b[:2], grp_a, grp_b, text)
        chunk, x, y, times = self._merged(links)
        n_pairs = np.bincount(chunk, minlength=n)
        heads = np.stack([np.where(same, n_a, -1), n_b, groups, n_pairs], axis=1).astype("<i4").tobytes()
        flat, ends = np.stack([(x << 32) | y, times], axis=1).astype("<i8").tobytes(), np.concatenate(([0], np.cumsum(n_pairs) * 16)).tolist()
        return [heads[_HEAD * k : _HEAD * k + _HEAD] + flat[ends[k] : ends[k + 1]] + b"".join(text[k]) for k in range(n)]

    @staticmethod
    def _blocks(ends_a: np.ndarray, ends_b: np.ndarray):
        """Ranges of both sides' tokens, of about ``BLOCK_TOKENS`` tokens of A, cut where tokens of both end."""
        i = j = 0
        while i < len(ends_a):
            step = BLOCK_TOKENS
            while True:
                k = min(i + step, len(ends_a))
                m = int(np.searchsorted(ends_b, ends_a[k - 1], "right"))
                shared = np.flatnonzero(np.isin(ends_a[i:k], ends_b[j:m], assume_unique=True))
                if len(shared):
                    k = i + int(shared[-1]) + 1
                    break
                step *= 2  # the last tokens of both end together, so some step reaches a cut
            m = int(np.searchsorted(ends_b, ends_a[k - 1], "right"))
            yield (i, k), (j, m)
            i, j = k, m

    def _block(self, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Group numbers of both sides' tokens in their order, and the links."""
        for side, columns in (("tokens_a", a), ("tokens_b", b)):
            self.db.register(side, pa.table(dict(zip(("doc", "id", "s", "e"), map(pa.array, columns), strict=True))))
        self.db.execute(_GROUPED_A)
        self.db.execute(_GROUPED_B)
        grp_a, grp_b = (self.db.execute(f"SELECT CAST(grp AS BIGINT) AS grp FROM grouped_{s} ORDER BY s").fetchnumpy()["grp"] for s in "ab")
        found = self.db.execute(_LINKS).fetchnumpy()
        for side in ("tokens_a", "tokens_b"):
            self.db.unregister(side)
        return np.asarray(grp_a), np.asarray(grp_b), [np.asarray(found[c], np.int64) for c in ("doc", "a", "b", "n")]

    def _write(self, a: tuple, b: tuple, grp_a: np.ndarray, grp_b: np.ndarray, text: list) -> None:
        """Add a block's written groups to those of their chunks."""
        at_a = np.arange(len(grp_a)) + np.searchsorted(grp_b, grp_a, "left")
        at_b = np.arange(len(grp_b)) + np.searchsorted(grp_a, grp_b, "right")
        chunk, word = np.empty(len(at_a) + len(at_b), np.int64), np.empty(len(at_a) + len(at_b), np.int64)
        chunk[at_a], chunk[at_b] = a[0], b[0]
        word[at_a] = a[1] + np.where(np.diff(grp_a, prepend=grp_a[0] - 1) != 0, 3, 1) * self.width
        word[at_b] = b[1] + np.where(np.diff(grp_b, prepend=grp_b[0] - 1) != 0, 2, 1) * self.width
        starts = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1))
        if text[chunk[0]]:  # this chunk began in the block before
            word[starts[1:]] %= self.width
        else:
            word[starts] %= self.width
        bounds = pa.array(np.append(starts, len(chunk)).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(bounds, self.words.take(pa.array(word))), "")
        for d, piece in zip(chunk[starts].tolist(), joined.to_pylist(), strict=True):
            text[d].append(piece.encode())

    def _merged(self, links: list) -> list[np.ndarray]:
        """The links of all blocks by chunk; those of a chunk in several blocks added up."""
        if not links:
            return [np.zeros(0, np.int64)] * 4
        doc, a, b, n = (np.concatenate(c) for c in zip(*links, strict=True))
        order = np.lexsort((b, a, doc))
        doc, a, b, n = doc[order], a[order], b[order], n[order]
        first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        return [doc[first], a[first], b[first], np.add.reduceat(n, first) if len(n) else n]


def _sums(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, places, values)
    return out


def _slice_row(values: dict) -> pa.RecordBatch:
    """One row of ``SLICE_SCHEMA``."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    fields = [(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in SLICE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values[name]], kind) for name, kind in fields], names=[name for name, _ in fields])


def aligned_slices(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per slice of documents (``SLICE_SCHEMA``)."""

    def work(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        with held(("alignment", a_path, b_path), lambda: Aligner(a_path, b_path)) as aligner:
            for batch in batches:
                for some in slices(batch, rows=4096, size=SLICE_BYTES):
                    row = aligner.aligned(some.column("text"))
                    yield _slice_row({"slice": number, "doc_ids": some.column("doc_id").to_pylist(), **row})
                    number += 1

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SLICE_SCHEMA)


def pair_counts(parts: DataFrame) -> DataFrame:
    """``pair`` (A's id in the upper 32 bits, B's in the lower), ``n`` documents that hold it, and whether no pair of its
    A id has more; partial counts of a task are merged before they leave it."""

    def work(batches):
        keys, counts = [], []

        def merged():
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            return found, _sums(at, np.concatenate(counts), len(found))

        for batch in batches:
            for pairs, holders in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(np.frombuffer(pairs.as_buffer(), "<i8").copy())
                counts.append(np.frombuffer(holders.as_buffer(), "<i8").copy())
                if sum(map(len, keys)) > MERGE_PAIRS:
                    found, total = merged()
                    keys, counts = [found], [total]
                    if len(found) > MERGE_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total)], names=["pair", "n"])
                        keys, counts = [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], names=["pair", "n"])

    found = written(parts.select("pairs", "holders").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")
    a_id = F.shiftright("pair", 32)
    most = found.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    return found.join(most, a_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _asked(parts: DataFrame) -> DataFrame:
    """(slice, place, pair) of every distinct pair of a slice."""

    def work(batches):
        for batch in batches:
            for number, pairs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = np.frombuffer(pairs.as_buffer(), "<i8")
                columns = [pa.array(np.full(len(keys), number)), pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(keys)]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "place", "pair"])

    return parts.select("slice", "pairs").mapInArrow(work, "slice long, place int, pair long")


def align(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """A row per document, and the corpus' pairs with their counts."""
    parts = written(aligned_slices(docs, a_path, b_path), "alignment-slices", "zstd")
    counts = written(pair_counts(parts), "alignment-counts")
    told = _asked(parts).join(counts, "pair").groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("place", "n", "best"))).alias("told"))
    rows = parts.drop("pairs", "holders").join(told, "slice", "left")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(name)[row]  # noqa: B023, E731
                sizes = np.asarray(cell("sizes").values)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                places, times = (np.frombuffer(cell(c).as_buffer(), t) for c, t in (("places", "<i4"), ("times", "<i8")))
                best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                if len(places):
                    _, n, most = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in cell("told").values.flatten())
                    np.add.at(best, doc, times * most[places].astype(np.int64))
                    np.add.at(total, doc, times * n[places])
                columns = [*(cell(c).values for c in _ARRAYS), pa.array(best), pa.array(total), cell("digests").values]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(work, schema), counts


def report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return align(docs, a_path, b_path)[0]
