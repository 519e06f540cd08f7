"""SimHash near-duplicates by pigeonring filtering.

The 64 fingerprint bits lie on a ring of ``SEGMENTS`` segments.  Two fingerprints within ``TAU`` bits must have
a segment from which every chain of l consecutive segments differs in at most ``floor(l * TAU / SEGMENTS)``
bits (the pigeonring principle).  With five segments and four bits the budgets are 0, 1, 2, 3, 4: one segment
is equal, and the next one differs in at most one bit, so one half of it is equal too.  The equal segment and the equal
half are the bucket key of the shuffle (ten rows a fingerprint, some six million buckets); within a bucket each
fingerprint goes to the sub-bucket of the other half and to those one flip away, which makes the two-segment chain;
longer chains prune the pairs of a sub-bucket, and only pairs that pass get the full Hamming check.

A bucket never yields all its pairs: pairs that link are merged at once, and the bucket returns one edge from
each member to the smallest fingerprint of its part.  Large sub-buckets are searched breadth first, so that a dense
group costs little more than a pass.  Components come from alternating large-star and small-star steps on tables in the
shared folder; a step's tables go when the next ones are written.

Defined results: null and wordless texts have fingerprint zero and link like any other; rows that
repeat a doc_id get the component of their own text; a null doc_id never names a component while the component has
another id; an empty table gives no rows; of all columns only doc_id and text are read, and ``keep_one`` passes the
others through, whatever their names; a text of any length is hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeframes.llm.common import bound_batches, drop, join_heads, slices, written, written_at

TAU = 4
WIDTHS = (13, 13, 13, 13, 12)
SHINGLE = 4
SEED = 42
SMALL_RUN = 8


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


SHIFTS = tuple(sum(WIDTHS[:i]) for i in range(len(WIDTHS)))
MASKS = tuple(((1 << w) - 1) << s for w, s in zip(WIDTHS, SHIFTS, strict=True))


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of every run of ``size`` words, repeats included; bytes.lower and bytes.split are ASCII only."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(size)), strict=False)]


def fold(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes: a bit is set if set in over half of its group.

    Eight byte lanes are summed at once in groups of up to 255 hashes."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full].astype(np.int64)
    parts = (n + 254) // 255
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    of = np.repeat(np.arange(len(full)), parts)
    at = np.concatenate(([0], np.cumsum(parts)[:-1]))
    cuts = first[of] + (np.arange(len(of)) - at[of]) * 255
    ones = np.uint64(0x0101010101010101)
    counts = np.empty((len(full), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & ones, cuts)
        counts[:, :, k] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), at, axis=0)
    bits = (2 * counts > n[:, None, None]).reshape(len(full), 64)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp, mark: the fingerprint of each whole text as a signed long, and a hash that tells an id's texts apart."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, rows=256, size=1 << 20):
                some = [shingle_hashes(x) for x in part.column("text").cast(pa.binary()).to_pylist()]
                flat = np.fromiter((h for s in some for h in s), np.uint64)
                fps = fold(flat, np.fromiter(map(len, some), np.int64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps), part.column("mark")], names=["doc_id", "fp", "mark"])

    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), mark(text).alias("mark")).mapInArrow(work, "doc_id long, fp long, mark long")


def mark(text: Column) -> Column:
    """64 bits of a text; a null text has its own."""
    return F.xxhash64(text.isNull(), text)


#: (shift, width) of the halves of each segment.
HALVES = tuple(((s, w // 2), (s + w // 2, w - w // 2)) for s, w in zip(SHIFTS, WIDTHS, strict=True))


def segment_keys() -> list:
    """Columns of the bucket keys of ``fp``: the start segment's number and bits, and one half of the next segment."""
    bits = lambda shift, width: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
    keys = []
    for i in range(len(WIDTHS)):
        for half, (shift, width) in enumerate(HALVES[(i + 1) % len(WIDTHS)]):
            key = F.shiftleft(bits(SHIFTS[i], WIDTHS[i]), 7).bitwiseOR(bits(shift, width)).bitwiseOR(F.lit((2 * i + half + 1) << 20))
            keys.append(key.cast("int"))
    return keys


def chained(keys: np.ndarray, fps: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Edges of whole buckets: each fingerprint goes to the sub-bucket of its next segment's other half and to those one
    flip away, some of the sub-buckets at a time where they are many."""
    tag = (keys.astype(np.int64) >> 20) - 1
    other = np.array([HALVES[(t // 2 + 1) % len(WIDTHS)][1 - t % 2] for t in range(2 * len(WIDTHS))])[tag]
    widths = other[:, 1]
    rest = ((fps >> other[:, 0].astype(np.uint64)) & ((1 << widths) - 1).astype(np.uint64)).astype(np.int64)
    base = keys.astype(np.int64) << 8 | rest
    turns = max(w for halves in HALVES for _, w in halves) + 1
    pieces = -(-len(keys) * turns // most)
    out = []
    for piece in range(pieces):
        some = []
        for flip in range(turns):
            at = np.flatnonzero(widths >= flip)
            sub = base[at] ^ (1 << flip >> 1)
            if pieces > 1:
                mine = sub % pieces == piece
                at, sub = at[mine], sub[mine]
            some.append((sub, fps[at]))
        sub, found = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.argsort(sub, kind="stable")
        out.append(buckets(sub[order], found[order]))
    return np.unique(np.concatenate(out, axis=1), axis=1)


def chains_hold(diff: np.ndarray) -> np.ndarray:
    """True where some start has all its chains within their budgets; the full check comes after."""
    m = len(WIDTHS)
    part = [np.bitwise_count(diff & np.uint64(x)).astype(np.int64) for x in MASKS]
    some = np.zeros(diff.shape, bool)
    for i in range(m):
        total, ok = part[i], part[i] <= TAU // m
        for length in range(2, m):
            total = total + part[(i + length - 1) % m]
            ok = ok & (total <= length * TAU // m)
        some |= ok
    return some


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a ^ b
    ok = np.zeros(diff.shape, bool)
    near = chains_hold(diff)
    ok[near] = np.bitwise_count(diff[near]) <= TAU
    return ok


def search(fps: np.ndarray) -> np.ndarray:
    """For distinct fingerprints of one bucket, the smallest fingerprint reachable within it.

    Breadth first over what has not been reached: each member is compared with unreached ones only."""
    fps = np.sort(fps)
    root = fps.copy()
    left = np.arange(len(fps))
    while len(left):
        start, left = left[0], left[1:]
        front = np.array([start])
        while len(front) and len(left):
            found = np.zeros(len(left), bool)
            for k in front:
                rest = np.flatnonzero(~found)
                if not len(rest):
                    break
                found[rest[linked(fps[left[rest]], fps[k])]] = True
            front, left = left[found], left[~found]
            root[front] = fps[start]
    return np.stack([fps, root])


def buckets(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Edges (fp, smaller fp) of the runs of equal keys."""
    out = []
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((start, [len(keys)])))
    small = np.repeat(size <= SMALL_RUN, size)
    for d in range(1, SMALL_RUN):
        at = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        a, b = fps[at], fps[at + d]
        ok = (a != b) & linked(a, b)
        out.append(np.stack([np.maximum(a[ok], b[ok]), np.minimum(a[ok], b[ok])]))
    for s, n in zip(start[size > SMALL_RUN], size[size > SMALL_RUN], strict=True):
        found = search(np.unique(fps[s : s + n]))
        out.append(found[:, found[0] != found[1]])
    return np.unique(np.concatenate(out, axis=1), axis=1)


def edges(classes: DataFrame) -> DataFrame:
    """Edges a > b (unsigned order) that connect all distinct fingerprints within TAU bits of each other."""
    spark = classes.sparkSession
    keyed = classes.select(F.explode(F.array(*segment_keys())).alias("key"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(batches):
        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1].view(np.int64))], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            if cut:
                yield rows(chained(np.concatenate([*(k for k, _ in held), keys[:cut]]), np.concatenate([*(f for _, f in held), fps[:cut]])))
                held = []
            held.append((keys[cut:], fps[cut:]))
        if held:
            yield rows(chained(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])))

    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(work, "a long, b long").distinct()


def components(pairs: DataFrame, name: str = "links") -> DataFrame:
    """node, root for every node of the edges (a, b): alternating large-star and small-star steps.

    Only minima are gathered per node, and the edges of a hub meet its minimum in several tasks; every step is a table in
    the shared folder."""
    now, path = written_at(pairs.select("a", "b").filter("a <> b"), f"{name}-edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        low, low_path = written_at(low.select("a", F.least("a", "m").alias("m"), "n"), f"{name}-low")
        large = join_heads(both.filter("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = written_at(large.filter("a <> b"), f"{name}-large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least, least_path = written_at(down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-least")
        small = join_heads(down, least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now, small_path = written_at(small.select("e.a", "e.b").filter("a <> b").distinct(), f"{name}-small")
        drop(path, low_path, large_path, least_path)
        path = small_path
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, mark of every row, and the least (without id, doc_id, mark) of its component as ``least``.

    Copies of one text, and the members of one component, meet their one head in several tasks where they are many."""
    fps = written(fingerprints(docs), "simhash-fps")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    classes = written(fps.groupBy("fp").agg(first.alias("rep"), F.count(F.lit(1)).alias("copies")), "simhash-classes")
    links = components(edges(classes), "simhash")
    rooted = classes.join(links, classes.fp == links.node, "left").select("fp", "rep", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-rooted")
    least = written(rooted.groupBy("root").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-least")
    labels = written(join_heads(rooted, least, "root").select("fp", "least", F.col("copies").alias("n")), "simhash-labels")
    return join_heads(fps, labels, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: that of the smallest doc_id, and of several texts with that id the one of the smallest hash.

    A row without an id, or whose id other texts have too, goes only if its own text is a near duplicate.  Rows that
    repeat both id and text are duplicates: the one whose columns have the smallest hash stays.  What goes is usually
    the shorter list, so rows are held against that; its table has a known size, by which Spark broadcasts it or moves
    the text once, by doc_id."""
    found = grouped(docs.select("doc_id", "text"))
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))
    marks = written(found.groupBy("doc_id", "mark").agg(F.bool_or(kept).alias("kept"), F.count(F.lit(1)).alias("n")), "simhash-marks")
    gone = written(marks.filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__gone_mark")), "simhash-gone")
    id_, mark_ = F.col("__row.doc_id").cast("long"), mark(F.col("__row.text").cast("string"))
    rows = docs.select(F.struct("*").alias("__row")).join(gone, id_.eqNullSafe(F.col("__gone")) & (mark_ == F.col("__gone_mark")), "left_anti")
    if marks.filter("kept and n > 1").limit(1).count():
        rows = rows.groupBy(id_.alias("__id"), mark_.alias("__mark")).agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return rows.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))
