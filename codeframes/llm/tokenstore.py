"""A content-addressed store of token ids.

A rolling hash over ``WINDOW`` ids cuts each document's id stream where the ids themselves say so, so equal
passages give equal chunks wherever they stand.  A chunk's address is the SHA-256 of its bytes.  The store is a folder
below the shared one with

* ``parts/kind=chunks/bucket=B`` (key, ids): each distinct chunk once, by the bucket of its address and sorted by address,
  ids as little-endian unsigned integers of two bytes, or of four if the vocabulary needs them;
* ``recipes`` in ascending doc_id order (part, pos, doc_id, before, n_tokens, digests, root): the chunks of a document,
  the ids before it in its part, and the root of the Merkle tree over its digests;
* ``manifest`` (part, n_docs, n_tokens, root): a Merkle tree over the recipes' roots and ids.

Reading puts every document together from its chunks and checks each chunk against its address, each document against
its recipe's root, and all recipes against the manifest.

Chunks and recipes leave the encoder through one shuffle; equal chunks then lie next to each other, so that keeping
one needs no memory.  A task drops chunks that it has sent lately, so a passage that a third of all documents share
costs a row or few per task.  A reading task opens the file of a bucket once and passes along it.

Defined results: a null text holds only the end id; rows that repeat a doc_id are documents of their own, next
to each other; a null doc_id sorts first; an empty table is an empty store; of all columns only doc_id and text are
read; a very long text is a slice by itself, and its chunks are like any other's.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeframes.llm.common import bound_batches, filesystem, held, shared_dir, slices
from codeframes.llm.pieces import word_end_encoder

END_ID = 1
WINDOW = 16
MEAN_BITS = 9
LEAST, MOST = 64, 4096

# Fixed values of the rolling hash: odd 32-bit multipliers.
_MIX, _BASE = 0x9E3779B1, 0x85EBCA6B

#: Addresses that a task remembers to have sent.
SENT_LIMIT = 1 << 18
#: Nodes below a node of the manifest's tree.
FAN = 1024
MANIFEST = "part int, n_docs long, n_tokens long, root binary"


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint32)
    down = np.full(n, pow(_BASE, -1, 1 << 32), np.uint32)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def boundaries(ids: np.ndarray, sizes: np.ndarray | None = None) -> list[list[int]]:
    """Ends of the chunks of each of the id streams that lie in ``ids`` one after the other."""
    sizes = np.array([len(ids)]) if sizes is None else sizes
    n = len(ids)
    up, down = (x[:n] for x in _powers(1 << max(12, int(n).bit_length())))
    mixed = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(_MIX)
    mixed ^= mixed >> np.uint32(15)
    mixed *= down
    prefix = np.zeros(n + 1, np.uint32)
    np.cumsum(mixed, dtype=np.uint32, out=prefix[1:])
    window = prefix[1:].copy()
    window[WINDOW:] -= prefix[1 : max(1, n + 1 - WINDOW)]
    stops = np.cumsum(sizes)
    starts = stops - sizes
    for r in range(WINDOW - 1):  # no window begins before its stream
        at = starts[sizes > r]
        window[at + r] = prefix[at + r + 1] - prefix[at]
    window *= up
    marks = np.flatnonzero(window >> np.uint32(32 - MEAN_BITS) == 0) + 1
    cut = np.searchsorted(marks, starts, "right").tolist() + [len(marks)]
    found = []
    for k, (first, stop) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
        ends, start, size = [], 0, stop - first
        for m in [*(marks[cut[k] : cut[k + 1]] - first).tolist(), size]:
            m = min(m, size)
            while m - start > MOST:
                start += MOST
                ends.append(start)
            if m > start and (m - start >= LEAST or m == size):
                ends.append(m)
                start = m
        found.append(ends)
    return found


def merkle_root(digests: list[bytes]) -> bytes:
    level = list(digests)
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


class Store(NamedTuple):
    path: str
    buckets: int
    width: int
    chunks: DataFrame
    recipes: DataFrame
    manifest: DataFrame


def _bucket(digest: str, buckets: int) -> Column:
    """The number of the partition that ``repartition(buckets, digest)`` deals a digest to, which names its folder."""
    return F.pmod(F.hash(digest), F.lit(buckets))


def write_store(docs: DataFrame, tokenizer_path: str) -> Store:
    """Encode, cut and store ``docs``; all three tables are written when this returns."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), END_ID + 1) <= 1 << 16 else 4
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark, "store")

    def encode(batches):
        sent: set[bytes] = set()
        with held(("store", tokenizer_path), lambda: word_end_encoder(tokenizer_path)) as encoder:
            for batch in batches:
                for some in slices(batch, rows=4096, size=6 << 20):
                    if len(sent) > SENT_LIMIT:
                        sent.clear()
                    yield from _cut_slice(some.column("doc_id"), encoder.encode(some.column("text")), sent, width)

    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # chunks and recipes share one shuffle: a chunk goes by its digest, a recipe by that of its first chunk and its id
    made = rows.mapInArrow(encode, "doc_id long, key binary, ids binary, digests array<binary>, sizes array<int>")
    dealt = made.repartition(n, "key").sortWithinPartitions("key")

    def once(batches):
        last = None  # of equal chunks, which lie next to each other, the first is stored
        for batch in batches:
            keys, is_chunk = batch.column("key"), batch.column("ids").is_valid().to_numpy(zero_copy_only=False)
            names = keys.to_pylist()
            keep = np.ones(len(names), bool)
            for i in np.flatnonzero(is_chunk).tolist():
                keep[i] = names[i] != last
                last = names[i]
            yield batch.filter(pa.array(keep))

    stored = dealt.mapInArrow(once, "doc_id long, key binary, ids binary, digests array<binary>, sizes array<int>")
    kind = F.when(F.col("ids").isNotNull(), "chunks").otherwise("staged").alias("kind")
    bucket = F.when(F.col("ids").isNotNull(), _bucket("key", n)).otherwise(F.lit(-1)).alias("bucket")
    stored.select("*", kind, bucket).sortWithinPartitions("kind", "bucket", "key").write.partitionBy("kind", "bucket").option("compression", "zstd").parquet(f"{path}/parts")
    chunks = spark.read.schema("key binary, ids binary, kind string, bucket int").parquet(f"{path}/parts").filter("kind = 'chunks'").select("bucket", F.col("key").alias("digest"), "ids")
    staged = spark.read.schema("doc_id long, digests array<binary>, sizes array<int>, kind string, bucket int").parquet(f"{path}/parts").filter("kind = 'staged'")

    def recipes(batches):
        from pyspark import TaskContext

        part, pos, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            out = []
            for doc_id, digests, sizes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digests", "sizes")), strict=True):
                out.append((part, pos, doc_id, before, sum(sizes), digests, merkle_root(digests)))
                pos, before = pos + 1, before + sum(sizes)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary())
            names = ["part", "pos", "doc_id", "before", "n_tokens", "digests", "root"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    ordered = staged.select("doc_id", "digests", "sizes").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    schema = "part int, pos long, doc_id long, before long, n_tokens long, digests array<binary>, root binary"
    ordered.mapInArrow(recipes, schema).write.parquet(f"{path}/recipes")
    found = spark.read.schema(schema).parquet(f"{path}/recipes")
    manifest(found).write.parquet(f"{path}/manifest")
    return Store(path, n, width, chunks, found, spark.read.schema(MANIFEST).parquet(f"{path}/manifest"))


def _cut_slice(doc_ids, streams: list[np.ndarray], sent: set[bytes], width: int):
    """Rows of the documents' recipes and of chunks that this task hasn't sent yet."""
    streams = [np.append(x, np.uint32(END_ID)) for x in streams]
    digests, sizes, names, data = [], [], [], []
    for ids, ends in zip(streams, boundaries(np.concatenate(streams), np.array([len(x) for x in streams])), strict=True):
        small, at, mine = ids.astype(f"<u{width}").tobytes(), 0, []
        for stop in ends:
            chunk = small[at * width : stop * width]
            mine.append(name := hashlib.sha256(chunk).digest())
            if name not in sent:
                sent.add(name)
                names.append(name)
                data.append(chunk)
            at = stop
        digests.append(mine)
        sizes.append(np.diff([0, *ends]).tolist())
    keys = [hashlib.sha256(d[0] + b"%d" % i).digest() for i, d in enumerate(digests)]
    fields = ["doc_id", "key", "ids", "digests", "sizes"]
    lists = (pa.list_(pa.binary()), pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(keys, pa.binary()), pa.nulls(len(keys), pa.binary()), pa.array(digests, lists[0]), pa.array(sizes, lists[1])], names=fields)
    if names:
        yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), pa.array(names, pa.binary()), pa.array(data, pa.binary()), *(pa.nulls(len(names), t) for t in lists)], names=fields)


def manifest(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, root: a Merkle tree over the recipes' roots, ``FAN`` to a node, up to a root per part."""
    sums = recipes.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("pos").alias("last"))
    most = sums.agg(F.max("last")).first()[0] or 0
    level = recipes.select("part", F.col("pos").alias("at"), F.concat("root", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("node"))
    while True:  # as many levels as the largest part needs
        nodes = F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: F.hex(x["node"]))
        level = level.groupBy("part", F.floor(F.col("at") / FAN).alias("at")).agg(F.unhex(F.sha2(F.array_join(nodes, ","), 256)).alias("node"))
        most //= FAN
        if not most:
            break
    return sums.join(level.select("part", F.col("node").alias("root")), "part").select("part", "n_docs", "n_tokens", "root")


def check_manifest(store: Store) -> None:
    """An error if the recipes aren't those that the manifest was made of; both have a row per part."""
    if sorted(map(tuple, manifest(store.recipes).collect())) != sorted(map(tuple, store.manifest.collect())):
        raise ValueError("the recipes don't match the store's manifest")


def _steps(store: Store, recipes: DataFrame) -> DataFrame:
    """part, pos, k, digest, bucket of every chunk of ``recipes``, dealt by digest, and by document too where a digest is hot.

    A digest is hot if it has over an eighth of an even share of the steps; so there are ``8 * n`` of them at most."""
    spark = recipes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = recipes.select("part", "pos", F.posexplode("digests").alias("k", "digest"))
    total = recipes.agg(F.sum(F.size("digests"))).first()[0] or 0
    hot = steps.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > max(64, total // (8 * n))).select("digest", F.lit(True).alias("hot"))
    hot = F.broadcast(spark.createDataFrame(hot.collect(), "digest binary, hot boolean"))  # 8 * n rows at most
    salt = F.pmod(F.hash("part", "pos"), F.lit(n)).cast("string").cast("binary")
    key = F.when(F.col("hot"), F.concat("digest", salt)).otherwise(F.col("digest"))
    dealt = steps.join(hot, "digest", "left").select("part", "pos", "k", "digest", _bucket("digest", store.buckets).alias("bucket"), key.alias("key"))
    return dealt.repartition(n, "key").sortWithinPartitions("bucket", "digest").drop("key")


def _stored(store: Store, recipes: DataFrame) -> DataFrame:
    """part, pos, k, ids: the chunks of ``recipes``, each bucket's file read once, every chunk checked against its address."""
    root, steps = f"{store.path}/parts/kind=chunks", _steps(store, recipes)

    def chunks_of(bucket: int):
        """(digest, data) of a bucket in the order of digests."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        def read(path):
            with files.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(1024, columns=["key", "ids"]):
                    yield from zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True)

        files, folder = filesystem(f"{root}/bucket={bucket}")
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return heapq.merge(*(read(f.path) for f in found if f.path.endswith(".parquet")))

    def work(batches):
        bucket, source, name, data = None, iter(()), None, b""
        for batch in batches:
            found = []
            for b, digest in zip(batch.column("bucket").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                if b != bucket:
                    bucket, source, name = b, chunks_of(b), None
                while name is None or name < digest:
                    name, data = next(source, (b"", None))
                    if data is None:
                        raise ValueError(f"stored chunks lack {digest.hex()}")
                    if name == digest and hashlib.sha256(data).digest() != name:
                        raise ValueError(f"chunk {name.hex()} is damaged")
                if name != digest:
                    raise ValueError(f"stored chunks lack {digest.hex()}")
                found.append(data)
            for part in range(0, len(found), 4096):
                some = batch.slice(part, 4096)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("part", "pos", "k")), pa.array(found[part : part + 4096], pa.binary())], names=["part", "pos", "k", "ids"])

    return steps.mapInArrow(work, "part int, pos long, k int, ids binary")


def reassembled(store: Store, recipes: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish(doc_id, before, part, ids)`` of each recipe, ids as an array put together from the stored chunks, as a row of
    ``schema``.  The Merkle root of what was read must be the recipe's."""
    spark = recipes.sparkSession
    n, width = int(spark.conf.get("spark.sql.shuffle.partitions")), store.width
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = recipes.select("part", "pos", F.lit(-1).alias("k"), none("binary", "ids"), "doc_id", "before", "root")
    rows = _stored(store, recipes).select("part", "pos", "k", "ids", none("long", "doc_id"), none("long", "before"), none("binary", "root"))
    names = [f.split()[0] for f in schema.split(", ")]
    types = spark.createDataFrame([], schema).schema

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in types]
        head, parts = None, []

        def whole():
            data = b"".join(parts)
            if merkle_root([hashlib.sha256(p).digest() for p in parts]) != head[2]:
                raise ValueError("a recipe doesn't match its stored chunks")
            return finish(head[0], head[1], head[3], np.frombuffer(data, f"<u{width}"))

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            part, k, ids, doc_id, before, root = (batch.column(c).to_pylist() for c in ("part", "k", "ids", "doc_id", "before", "root"))
            for i in range(batch.num_rows):
                if k[i] < 0:
                    if head:
                        out.append(whole())
                    head, parts = (doc_id[i], before[i], root[i], part[i]), []
                else:
                    parts.append(ids[i])
            if out:
                yield made(out)
        if head:
            yield made([whole()])

    return heads.unionByName(rows).repartition(n, "part", "pos").sortWithinPartitions("part", "pos", "k").mapInArrow(work, schema)


def read_documents(store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every recipe, from the ids of its stored chunks; the manifest must hold."""
    spark = store.recipes.sparkSession
    check_manifest(store)
    # one row per part, whose number is that of the range partitions
    base, starts = 0, []
    for r in sorted(store.manifest.select("part", "n_tokens").collect()):
        starts.append((r.part, base))
        base += r.n_tokens
    bases = F.broadcast(spark.createDataFrame(starts, "part int, base long"))

    def finish(doc_id, before, part, ids):
        return part, doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    docs = reassembled(store, store.recipes, finish, "part int, doc_id long, before long, n_tokens long, ids_crc32 long").join(bases, "part")
    return docs.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def reconstruct(store: Store, doc_ids: DataFrame) -> DataFrame:
    """doc_id, ids of the wanted documents, chunk by chunk."""
    wanted = store.recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select(store.recipes.columns)
    return reassembled(store, wanted, lambda doc_id, before, part, ids: (doc_id, ids.astype(np.int64)), "doc_id long, ids array<long>")
