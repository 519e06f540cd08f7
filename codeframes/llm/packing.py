"""Best-fit packing with bounded space: token sequences of at most ``CAPACITY`` ids.

A packer keeps at most ``OPEN_BINS`` bins and places each piece as it arrives.  A bitset has a bit for each amount of
free space that some open bin has; the best fit is the lowest set bit at or above the piece's length.  If no bin fits
and all are open, the fullest closes first.  Pieces reach packers by a hash of their document, ``PER_PACKER`` or so to
each, in the order of that hash, so packing again gives the same sequences; each packer leaves at most ``OPEN_BINS`` bins
unfilled, which is a small share of what it packs.  ``lookahead`` is how many arrived pieces a packer may hold and place
the longest first; 1 is the plain online method.  Documents that differ in a column named by ``apart`` share no sequence: a packer
takes one value after the other, each with open bins of its own.

Defined results: a null text is one end id; documents longer than the capacity are cut so that only their first
piece is shorter; rows that repeat a doc_id, or have none, are packed one by one; an empty table gives no rows; of all
columns only doc_id, text and that of ``apart`` are read, and rows without a value there belong together.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframes.llm.common import bound_batches, held, slices, written
from codeframes.llm.pieces import byte_level_encoder

CAPACITY = 2048
OPEN_BINS = 1024
LOOKAHEAD = 1
PER_PACKER = 131_072
END_ID = 0

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Packer:
    """Online best fit; ``place`` returns (bin, offset), bins being numbered from ``made``."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, made: int = 0):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.made = 0, 0, made
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.count >= self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:  # the new bin is the fullest: it closes itself
                    return at, self.capacity - free
                self._take(fullest)
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.count += 1
        return at, self.capacity - free


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, (first if first and s == 0 else capacity)) for s in starts]


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, apart: str | None = None) -> DataFrame:
    """The pieces of every whole text, with the checksum of their ids, and the document's ``apart`` as a string."""
    end = np.array([END_ID], "<u4").tobytes()

    def work(batches):
        with held(("packing", tokenizer_path), lambda: byte_level_encoder(tokenizer_path)) as encoder:
            for batch in batches:
                for some in slices(batch, rows=4096, size=4 << 20):
                    yield bounds_of(some, encoder.encode(some.column("text")))

    def bounds_of(some, streams) -> pa.RecordBatch:
        rows, owners = [], []
        for at, (doc_id, ids) in enumerate(zip(some.column("doc_id").to_pylist(), streams, strict=True)):
            ids = ids.tobytes() + end
            for k, (s, n) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                rows.append((doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
                owners.append(at)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        if apart:
            columns, names = [*columns, some.column("apart").take(pa.array(owners))], [*names, "apart"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    bound_batches(docs.sparkSession)
    own = [F.col(apart).cast("string").alias("apart")] if apart else []
    schema = PIECE_SCHEMA + (", apart string" if apart else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own).mapInArrow(work, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_packer: int = PER_PACKER, lookahead: int = LOOKAHEAD) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset; sequences hold one value of ``apart``, if there is such a column."""
    packers = max(1, -(-pieces.count() // per_packer))
    apart = ["apart"] if "apart" in pieces.columns else []

    def work(batches):
        from pyspark import TaskContext

        base, packer, names = TaskContext.get().partitionId() << 40, Packer(capacity, open_bins), ["doc_id", "piece", "start", "length", "ids_crc32"]
        value = None

        def placed(block: pa.Table) -> pa.RecordBatch:
            nonlocal packer, value
            lengths = block.column("length").to_numpy()
            bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            values = block.column("apart").to_pylist() if apart else [None] * len(lengths)
            change = np.cumsum([v != u for v, u in zip(values, [value, *values], strict=False)])
            for i in np.lexsort((-lengths, np.arange(len(lengths)) // lookahead, change)).tolist():
                if values[i] != value:
                    packer, value = Packer(capacity, open_bins, packer.made), values[i]
                bins[i], offsets[i] = packer.place(int(lengths[i]))
            columns = [block.column(c).combine_chunks() for c in names]
            return pa.RecordBatch.from_arrays([*columns, pa.array(base + bins), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

        # several blocks of the lookahead at a time; one piece at a time is the order of arrival itself
        step = max(lookahead, 1024) // lookahead * lookahead
        some: list[pa.RecordBatch] = []
        for batch in batches:
            some.append(batch)
            if sum(b.num_rows for b in some) >= step:
                rows = pa.Table.from_batches(some)
                whole = rows.num_rows - rows.num_rows % step
                for i in range(0, whole, step):
                    yield placed(rows.slice(i, step))
                some = rows.slice(whole).to_batches()
        if some:
            yield placed(pa.Table.from_batches(some))

    order = F.xxhash64("doc_id", "ids_crc32")
    dealt = pieces.withColumn("__order", order).repartition(packers, "__order").sortWithinPartitions(*apart, "__order", "doc_id", "piece", "start")
    return dealt.select("doc_id", "piece", "start", "length", "ids_crc32", *apart).mapInArrow(work, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, apart: str | None = None) -> DataFrame:
    return pack(written(cut(docs, tokenizer_path, apart=apart), "packing-pieces"))
