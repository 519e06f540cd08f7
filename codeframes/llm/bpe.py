"""Byte-level BPE by merge replay over the distinct words of the whole corpus.

1. Texts are cut into words, a slice of texts at a time.  A slice keeps its texts as numbers of its own distinct
   words and sends each distinct word out once, packed by cell; a word's cell is a hash of it.
2. Cells are shuffled, so that each distinct word of the corpus lies in one place.  There the replay runs: all distinct
   words of a cell are one array of symbols, an inverted index leads from each mergeable pair (by the id it merges to)
   to the positions where it stands; ids are taken in rank order, every position of the rank is merged from left to
   right, and only the pairs that touch a merged symbol are indexed anew.  A word is encoded once for the whole corpus,
   however many slices have it.
3. The ids go back to the tasks that cut their slices, packed, by way of files, and each text is put together from its words.

There are ``CELLS`` cells to a shuffle partition, so a task holds a small share of a partition at a time.  A word has one
entry per slice at most, so no word makes its cell hot.  Should a merge make a pair of lower rank (which needs
a rank file whose merges are out of order), the word is encoded alone, pair by pair, so results are those of the plain
procedure for any rank file.

Defined results: a null text is empty: no ids, and the digests of nothing; rows that repeat a doc_id, or have none, are
texts of their own; an empty table gives no rows; of all columns only doc_id and text are read; a very long text is a
slice by itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframes.llm.common import bound_batches, filesystem, held, shared_dir, slices, written
from codeframes.llm.pieces import exact_white, gathered, led_pieces, quick_cut

#: About the bytes of text in a slice.
SLICE_BYTES = 16 << 20
#: Cells per partition of the shuffle.
CELLS = 4
# Of a text's word numbers: those of one byte, and the first that takes more than two.
_SINGLE = 192
_DOUBLE = _SINGLE + (255 - _SINGLE) * 256
PARTS = pa.list_(pa.struct([("cell", pa.int32()), ("sizes", pa.binary()), ("data", pa.binary())]))

#: Pairs whose outcome is remembered between blocks.
PAIR_LIMIT = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encode_alone(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain procedure: the leftmost pair of the lowest rank merges, until none does."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        low, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if low == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = vocabulary(ranks)
        self.bytes_to_id = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}

    def merged(self, key: int) -> int:
        """The id that a pair (the first id in the high bits) merges to, or -1."""
        found = self.pairs[key] = self.ranks.get(self.vocab[key >> 32] + self.vocab[key & 0xFFFFFFFF], -1)
        return found

    def _first_index(self, symbols: list[int], spans: list[tuple[int, int, int]]) -> dict[int, list[int]]:
        """Mergeable pairs of the words as they begin: rank -> positions, from the distinct pairs alone."""
        if len(self.pairs) > PAIR_LIMIT:
            self.pairs.clear()
        s = np.array(symbols, np.int64)
        if len(s) < 2:
            return {}
        inside = np.ones(len(s), bool)
        inside[np.array([b - 1 for _, a, b in spans if b > a], np.int64)] = False
        at = np.flatnonzero(inside)
        keys, back = np.unique(s[at] << 32 | s[at + 1], return_inverse=True)
        found = np.array([self.merged(k) for k in keys.tolist()], np.int64)[back] if len(at) else at
        at, found = at[found >= 0], found[found >= 0]
        order = np.argsort(found, kind="stable")
        ids, first = np.unique(found[order], return_index=True)
        return {i: part.tolist() for i, part in zip(ids.tolist(), np.split(at[order], first[1:]), strict=True)} if len(ids) else {}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        to_id, merged, ranks, known = self.bytes_to_id, self.merged, self.ranks, self.pairs.get
        out: list[list[int] | None] = [None] * len(words)
        symbols: list[int] = []
        spans: list[tuple[int, int, int]] = []
        for w, word in enumerate(words):
            if word in ranks:
                out[w] = [ranks[word]]  # whole words of the vocabulary aren't merged up
            else:
                spans.append((w, len(symbols), len(symbols) + len(word)))
                symbols.extend(map(to_id.__getitem__, word))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for _, a, b in spans:
            if b > a:
                before[a] = after[b - 1] = -1
        index = self._first_index(symbols, spans)
        heap = list(index)
        heapq.heapify(heap)
        odd: list[int] = []

        def note(new: int, at: int) -> None:
            """A pair that a merge has made goes to the index under its own rank."""
            if new < rank:
                odd.append(at)
            elif new in index:
                index[new].append(at)
            else:
                index[new] = [at]
                heapq.heappush(heap, new)

        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, ())
            for p in sorted(places) if len(places) > 1 else places:
                q = after[p]
                s = symbols[p]
                if q < 0 or s < 0 or known(s << 32 | symbols[q]) != rank:
                    continue  # one of the two went into another symbol
                symbols[p], symbols[q] = rank, -1
                r = after[p] = after[q]
                if r >= 0:
                    before[r] = p
                    key = rank << 32 | symbols[r]
                    new = known(key)
                    if new is None:
                        new = merged(key)
                    if new >= 0:
                        note(new, p)
                r = before[p]
                if r >= 0:
                    key = symbols[r] << 32 | rank
                    new = known(key)
                    if new is None:
                        new = merged(key)
                    if new >= 0:
                        note(new, r)
        for w, a, b in spans:
            out[w] = [s for s in symbols[a:b] if s >= 0]
        if odd:
            starts = np.array([a for _, a, _ in spans])
            for k in {int(np.searchsorted(starts, p, "right")) - 1 for p in odd}:
                w = spans[k][0]
                out[w] = encode_alone(words[w], ranks)
        return out


class Words:
    """A slice of texts as numbers of its distinct words; the most frequent word is number 0."""

    def __init__(self, texts: pa.Array, cut: Callable[[str], list[str]]):
        pieces = led_pieces(pc.fill_null(texts, ""))
        number: dict[str, int] = {}
        cuts = [cut(p) if p else [] for p in pieces.pieces]
        sizes = np.fromiter(map(len, cuts), np.int32, len(cuts))
        flat = np.fromiter((number.setdefault(w, len(number)) for c in cuts for w in c), np.int32, int(sizes.sum()))
        index, ends = gathered(pieces.index, sizes, flat)
        counts = np.bincount(index, minlength=len(number))
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        words = list(number)
        self.words = [words[i].encode() for i in order.tolist()]
        self.index = place[index] if len(index) else index
        self.ends = np.concatenate(([0], ends)).astype(np.int64)[pieces.bounds[1:]]

    def cells(self, count: int) -> np.ndarray:
        """The cell of every word."""
        return np.fromiter((crc32(w) % count for w in self.words), np.int32, len(self.words))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, so that their zero bytes compress well."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _packed_ranks(ranks: np.ndarray) -> bytes:
    """Numbers of words in texts, of which small ones are frequent: one byte for the ``_SINGLE`` smallest, which entropy coding
    makes shorter still; two for the next ones, and four for the rest, in streams of their own."""
    ranks = ranks.astype(np.int64)
    heads = np.minimum(ranks, 255).astype(np.uint8)
    middle = (ranks >= _SINGLE) & (ranks < _DOUBLE)
    heads[middle] = _SINGLE + ((ranks[middle] - _SINGLE) >> 8)
    heads[ranks >= _DOUBLE] = 255
    streams = (heads.tobytes(), ((ranks[middle] - _SINGLE) & 255).astype(np.uint8).tobytes(), (ranks[ranks >= _DOUBLE] - _DOUBLE).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
    packed = [zstandard.ZstdCompressor(level=3).compress(x) for x in streams]
    return np.array([len(x) for x in packed], "<i8").tobytes() + b"".join(packed)


def _unpacked_ranks(data: bytes) -> np.ndarray:
    ends = 24 + np.cumsum(np.frombuffer(data[:24], "<i8"))
    heads, lows, large = (np.frombuffer(zstandard.decompress(data[a:b]), np.uint8) for a, b in zip([24, *ends[:-1].tolist()], ends.tolist(), strict=True))
    ranks = heads.astype(np.int32)
    middle = (heads >= _SINGLE) & (heads < 255)
    ranks[middle] = _SINGLE + ((ranks[middle] - _SINGLE) << 8) + lows
    ranks[heads == 255] = _DOUBLE + np.ascontiguousarray(large.reshape(4, -1).T).view("<u4").ravel().astype(np.int32)
    return ranks


def _pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    """Sizes and bytes of words."""
    return _packed(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def _unpack_words(sizes: bytes, data: bytes) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(_unpacked(sizes), dtype=np.int64)))
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(zstandard.decompress(data))])


def cutter(pattern: str) -> Callable[[str], list[str]]:
    import regex

    return quick_cut(regex.compile(exact_white(pattern)).findall)


def cut_words(docs: DataFrame, pattern: str, cells: int) -> DataFrame:
    """A row per slice: its documents, where each ends, its texts as packed word numbers, the words' cells, and its distinct
    words by cell."""

    def work(batches):
        from pyspark import TaskContext

        cut, number = cutter(pattern), TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in slices(batch, rows=1 << 16, size=SLICE_BYTES):
                w = Words(some.column("text"), cut)
                cell = w.cells(cells)
                order = np.argsort(cell, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], cell[order][1:] != cell[order][:-1]))) if len(cell) else order
                parts = []
                for part in np.split(order, first[1:]) if len(cell) else ():
                    sizes, data = _pack_words([w.words[i] for i in part.tolist()])
                    parts.append({"cell": int(cell[part[0]]), "sizes": sizes, "data": data})
                one = lambda values, kind: pa.array([values], kind)
                columns = [
                    one(number, pa.int64()), one(some.column("doc_id").to_pylist(), pa.list_(pa.int64())), one(w.ends, pa.list_(pa.int64())),
                    one(_packed_ranks(w.index), pa.binary()), one(_packed(cell), pa.binary()), one(parts, PARTS),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "doc_ids", "ends", "places", "cells", "parts"])
                number += 1

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "slice long, doc_ids array<long>, ends array<long>, places binary, cells binary, parts array<struct<cell: int, sizes: binary, data: binary>>")


def encode_cell(replay: MergeReplay, rows: list[tuple[int, bytes, bytes]]) -> list[tuple[int, bytes, bytes]]:
    """(slice, sizes, words) of all of a cell's rows become (slice, sizes, ids), every distinct word encoded once."""
    columns = [_unpack_words(sizes, data) for _, sizes, data in rows]
    coded = pa.concat_arrays(columns).dictionary_encode()
    ids = replay.encode(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, ids), np.int32, len(ids))
    flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
    index = coded.indices.to_numpy()
    values, ends = gathered(index, sizes, flat)
    bounds = np.concatenate(([0], ends))
    out, at = [], 0
    for (owner, *_), column in zip(rows, columns, strict=True):
        to = at + len(column)
        out.append((owner, _packed(sizes[index[at:to]]), _packed(values[bounds[at] : bounds[to]])))
        at = to
    return out


def encode_words(staged: DataFrame, ranks_path: str) -> DataFrame:
    """slice, cell, sizes, ids: the ids of a slice's words, each distinct word of all slices encoded once."""
    n = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encoded(replay, cell, rows):
        found = encode_cell(replay, rows)
        kinds = (pa.int64(), pa.binary(), pa.binary())
        owners, sizes, ids = (pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True))
        return pa.RecordBatch.from_arrays([owners, pa.array([cell] * len(found), pa.int32()), sizes, ids], names=["slice", "cell", "sizes", "ids"])

    def work(batches):
        with held(("bpe", ranks_path), lambda: MergeReplay(load_ranks(ranks_path))) as replay:
            now, rows = None, []
            for batch in batches:
                for cell, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "slice", "sizes", "data")), strict=True):
                    if cell != now and rows:
                        yield encoded(replay, now, rows)
                        rows = []
                    now = cell
                    rows.append(row)
            if rows:
                yield encoded(replay, now, rows)

    parts = staged.select("slice", F.explode("parts").alias("p")).select("slice", "p.cell", "p.sizes", "p.data")
    return parts.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(work, "slice long, cell int, sizes binary, ids binary")


def assembled(docs: DataFrame, ranks_path: str, pattern: str, finish: Callable, schema: str) -> DataFrame:
    """``finish(doc_ids, ids as an Arrow list column)`` of every slice; ``finish`` gives the columns of ``schema``.

    Texts stay where they were cut: the ids of the words go to files by the task that cut their slices, from which the
    last stage reads those of its own slices."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = written(cut_words(docs, pattern, CELLS * n), "bpe-slices", codec="uncompressed")  # its columns are packed
    path = shared_dir(docs.sparkSession, "bpe-ids")
    found = encode_words(staged, ranks_path).withColumn("cutter", F.shiftright("slice", 32))
    ordered = found.repartition(n, "cutter").sortWithinPartitions("cutter", "slice", "cell")
    ordered.write.partitionBy("cutter").option("compression", "uncompressed").parquet(path)
    names = [f.split()[0] for f in schema.split(", ")]

    def ids_of(cutter: int) -> dict[int, list[tuple[int, bytes, bytes]]]:
        """(cell, sizes, ids) of the slices that a task cut."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, folder = filesystem(f"{path}/cutter={cutter}")
        parts: dict[int, list] = {}
        for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with files.open_input_file(info.path) as source:
                    rows = pq.ParquetFile(source).read(columns=["slice", "cell", "sizes", "ids"])
                for number, *part in zip(*(rows.column(c).to_pylist() for c in ("slice", "cell", "sizes", "ids")), strict=True):
                    parts.setdefault(number, []).append(part)
        return parts

    def put(text: dict, parts: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        cells = _unpacked(text["cells"])
        parts.sort(key=lambda p: p[0])
        none = [np.zeros(0, np.uint32)]
        sizes, flat = np.concatenate([_unpacked(p[1]) for p in parts] or none), np.concatenate([_unpacked(p[2]) for p in parts] or none)
        if len(sizes) != len(cells):
            raise ValueError(f"slice {text['slice']} has ids for {len(sizes)} of its {len(cells)} words")
        order = np.empty(len(cells), np.int32)  # ids lie by cell, and in a cell by the word's number
        order[np.argsort(cells, kind="stable")] = np.arange(len(cells), dtype=np.int32)
        values, ends = gathered(order[_unpacked_ranks(text["places"])], sizes.astype(np.int32), flat)
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], text["ends"])).astype(np.int64)]
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))
        return pa.RecordBatch.from_arrays(finish(pa.array(text["doc_ids"], pa.int64()), lists), names=names)

    def work(batches):
        cutter, parts = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                text = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if text["slice"] >> 32 != cutter:
                    cutter = text["slice"] >> 32
                    parts = ids_of(cutter)
                yield put(text, parts.pop(text["slice"], []))

    return staged.drop("parts").mapInArrow(work, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the ids of every whole text; ``pattern`` must not let a match cross the borders of ``SPACED`` pieces."""
    return assembled(docs, ranks_path, pattern, lambda doc_ids, ids: [doc_ids, ids], "doc_id long, ids array<int>")


def vocabulary(ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens by id."""
    found = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        found[rank] = token
    return found


def decode(ids: pa.ListArray, tokens: pa.Array, between: bytes | str = b"") -> pa.Array:
    """The tokens of each list of ids, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values)), pa.scalar(between, tokens.type))


def sha256_of(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes decoded from them."""

    def tables():
        vocab = vocabulary(load_ranks(ranks_path))
        return pa.array(vocab, pa.large_binary()), pa.array([str(i) for i in range(len(vocab))], pa.large_string())

    def finish(doc_ids, ids):
        with held(("bpe-names", ranks_path), tables) as (vocab, names):
            # a part of the documents at a time: their ids as text are several times as long
            sizes = np.diff(ids.offsets.to_numpy())
            group = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 18))) + 1, [len(sizes)]))
            numbers, decoded = [], []
            for a, b in zip(group[:-1].tolist(), group[1:].tolist(), strict=True):
                o = ids.offsets.to_numpy()[a : b + 1]
                part = pa.ListArray.from_arrays(pa.array(o - o[0]), ids.values.slice(int(o[0]), int(o[-1] - o[0])))
                numbers.append(sha256_of(decode(part, names, ",")))
                decoded.append(sha256_of(decode(part, vocab)))
            return [doc_ids, pa.array(sizes.astype(np.int64)), pa.concat_arrays(numbers), pa.concat_arrays(decoded)]

    return assembled(docs, ranks_path, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
