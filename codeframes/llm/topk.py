"""Exact top-k search by inner product with pivot-table elimination.

Components become floor(64 * x).  Distances from every vector to ``PIVOTS`` pivots are computed once.  By the
triangle inequality the largest difference of two vectors' pivot distances is a lower bound of their distance,
and, as the inner product is half of (|q|^2 + |x|^2 - distance^2), an upper bound of their score; the product of the
two lengths is another.  A query evaluates candidates in the order of their bounds, in rounds that double, and stops
where no bound reaches its k-th score.

Where bounds rule out too little, they cost more than they save: in high dimensions without clusters distances to
pivots differ too little.  A trial of ``TRIAL`` candidates per query block measures the share that bounds leave; above
``WORTH`` the block's other candidates are evaluated whole, by one dense product, which is exact too.  ``Part.products``
counts all products that were really computed, those of dense blocks included.

Queries lie in the shared folder in blocks.  A task reads its candidates as they come and holds one part of about
``PART_BYTES`` at a time, pivot table and copies counted; it streams the query blocks past each part, so neither side is
broadcast or collected and no join makes their product.  Parts and query blocks hold vectors of like length (a power of two
between them), so a long vector pads no short ones; vectors of different lengths meet on the shorter one's components.
Each query starts from a floor that its own row carries: its k-th score among a bounded sample; a part
returns at most k rows per query and none below the floor, each task passes on the k best of a query over its parts, and
the k best over all tasks are the result.

The sample is that of the smallest hashes of id and vector: at most ``SAMPLE`` rows and ``SAMPLE_COMPONENTS`` components,
without rows that hold over a sixteenth of these.  Pivots are picked far apart from it.  As any point can be a pivot, they
are cut to ``2 * SAMPLE_COMPONENTS`` components together; floors come from whole vectors only.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; shorter vectors
count as if filled up with zeros; a query's own id is never its candidate, rows that repeat an id included; rows that
repeat id and vector are one query and several candidates, rows that repeat an id with another vector are queries of
their own, told apart by ``query_key``; rows with null ids take no part; ties go to the smaller vec_id; an empty table
gives no rows; of all columns only vec_id and embedding are read; sums are exact while they stay below 2^53, and are
rounded beyond; components beyond the range of long count as its ends, and scores beyond it are given as its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeframes.llm.common import bound_batches, filesystem, held, kept_object, shared_dir, stored_object

K = 20
EVERY = 20
SCALE = 64
PIVOTS = 64
SAMPLE = 4096
SAMPLE_COMPONENTS = 4 << 20
QUERY_BLOCK = 256
#: Bytes of a block of queries, and of a part of the candidates with its pivot table and copies.
QUERY_BYTES = 4 << 20
PART_BYTES = 64 << 20
CANDIDATE_BLOCK = 8192
#: Candidates per query of the first round of evaluation.
FIRST_ROUND = 64
#: Candidates of a trial, and the share of pairs left by the bounds up to which they are worth their cost.
TRIAL = 512
WORTH = 0.25
#: Slack of the bounds against rounding, far below the steps of integer scores.
SLACK = 0.25


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v: rows that take part, components as floor(SCALE * x)."""
    wide = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("x")).filter(ok).select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("double")).alias("v"))


def length_class(size: Column | str) -> Column:
    """The number of doublings from 1 up to the length."""
    return F.ceil(F.log2(size)).cast("int")


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def by_length(column):
    """(positions, matrix) of the rows of an Arrow list column, those of one length class together."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    classes = np.ceil(np.log2(sizes))
    for c in np.unique(classes):
        at = np.flatnonzero(classes == c)
        yield at, matrix(column if len(at) == len(sizes) else column.take(pa.array(at)), int(sizes[at].max()))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products [row of a, row of b]; the shorter rows count as filled up with zeros."""
    width = min(a.shape[1], b.shape[1])
    return a[:, :width] @ b[:, :width].T


def parts_of(batches, pivots: np.ndarray, size: int = PART_BYTES):
    """``Part`` after ``Part`` of the rows of Arrow batches, each of one length class and about ``size`` bytes; what waits for
    its part stays below that size too."""
    waiting: dict[int, list] = {}
    cost = lambda x: x.shape[0] * (16 * x.shape[1] + 8 * len(pivots) + 64)  # noqa: E731  rows, a sorted copy, the table and its making
    total = lambda some: sum(cost(x) for _, x in some)

    def made(kind: int) -> Part:
        some = waiting.pop(kind)
        width = max(x.shape[1] for _, x in some)
        x = np.zeros((sum(len(ids) for ids, _ in some), width))
        lo = 0
        for ids, m in some:
            x[lo : lo + len(ids), : m.shape[1]] = m
            lo += len(ids)
        return Part(np.concatenate([ids for ids, _ in some]), x, pivots)

    for batch in batches:
        for lo in range(0, batch.num_rows, CANDIDATE_BLOCK):
            some = batch.slice(lo, CANDIDATE_BLOCK)
            ids = some.column("vec_id").to_numpy()
            for at, x in by_length(some.column("v")):
                kind = int(x.shape[1] - 1).bit_length()
                waiting.setdefault(kind, []).append((ids[at], x))
                while sum(map(total, waiting.values())) > size:
                    yield made(max(waiting, key=lambda c: total(waiting[c])))
    for kind in list(waiting):
        yield made(kind)


def pick_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows far from each other: each next one has the largest distance to those before."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", x, x)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * products(x, pivots)
    return np.sqrt(np.maximum(squares, 0))


class Best:
    """The best k of each query so far, and the floors that new scores must reach."""

    def __init__(self, n: int, floors: np.ndarray, k: int):
        self.n, self.k, self.floors = n, k, floors.copy()
        self.rows, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids, scores = np.concatenate((self.rows, rows)), np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(self.n))[rows]
        kth = np.flatnonzero(rank == self.k - 1)
        self.floors[rows[kth]] = np.maximum(self.floors[rows[kth]], scores[kth])
        self.rows, self.ids, self.scores = rows[rank < self.k], ids[rank < self.k], scores[rank < self.k]


class Part:
    """A part of the candidates with its pivot table, searched by blocks of queries against blocks of candidates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.squares = np.einsum("ij,ij->i", self.x, self.x)
        self.table = np.empty((len(pivots), len(ids)), np.float32)  # the bounds allow for the rounding
        for lo in range(0, len(ids), CANDIDATE_BLOCK):
            self.table[:, lo : lo + CANDIDATE_BLOCK] = distances(self.x[lo : lo + CANDIDATE_BLOCK], pivots).T
        self.lengths = np.sqrt(self.squares)
        self.products = 0

    def bounds(self, q: np.ndarray, q_table: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Upper bounds of the scores [query, candidate] from the largest difference of pivot distances, and from lengths."""
        gap = np.zeros((len(q), hi - lo), np.float32)
        for row, d in zip(self.table[:, lo:hi], q_table.T.astype(np.float32), strict=True):
            np.maximum(gap, np.abs(row[None, :] - d[:, None]), out=gap)
        rounding = 1e-6 * (float(np.abs(q_table).max(initial=0)) + float(self.table.max(initial=0)))
        low = np.maximum(gap.astype(np.float64) - rounding, 0)
        squares = (q**2).sum(axis=1)
        by_pivots = (squares[:, None] + self.squares[None, lo:hi] - low**2) / 2
        return np.minimum(by_pivots, np.sqrt(squares)[:, None] * self.lengths[None, lo:hi] * (1 + 1e-12)) + SLACK

    def search(self, queries: np.ndarray, q: np.ndarray, q_table: np.ndarray, floors: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of the query, ids and scores: the best k of each query at or above its floor."""
        best = Best(len(q), floors, k)
        lo, worth = 0, None
        while lo < len(self.ids):
            hi = min(lo + (TRIAL if worth is None else CANDIDATE_BLOCK), len(self.ids))
            own = queries[:, None] == self.ids[None, lo:hi]
            if worth:
                bound = self.bounds(q, q_table, lo, hi)
                bound[own] = -np.inf
                self._in_order(q, bound, lo, best)
            else:
                scores = products(q, self.x[lo:hi])
                self.products += scores.size
                scores[own] = -np.inf
                r, c = np.nonzero((scores >= best.floors[:, None]) & np.isfinite(scores))
                best.add(r, self.ids[lo + c], scores[r, c])
            if worth is None:  # what would the bounds have left of the trial, under the floors as they are now?
                worth = float((self.bounds(q, q_table, lo, hi) >= best.floors[:, None]).mean()) <= WORTH
            lo = hi
        return best.rows, best.ids, best.scores

    def _in_order(self, q: np.ndarray, bound: np.ndarray, lo: int, best: Best) -> None:
        """Evaluate the pairs of a block whose bounds reach the floors, the largest first, in rounds that double."""
        size = FIRST_ROUND
        while True:
            hope = (bound >= best.floors[:, None]) & np.isfinite(bound)
            left = int(hope.sum(axis=1).max(initial=0))
            if not left:
                return
            if left > size:
                least = np.partition(bound, bound.shape[1] - size, axis=1)[:, -size]
                hope &= bound >= least[:, None]
            r, c = np.nonzero(hope)
            at = np.unique(c)
            if 8 * len(r) < len(q) * len(at):  # few pairs: one by one
                width = min(q.shape[1], self.x.shape[1])
                scores = np.concatenate([np.einsum("ij,ij->i", q[r[i : i + QUERY_BLOCK], :width], self.x[lo + c[i : i + QUERY_BLOCK], :width]) for i in range(0, len(r), QUERY_BLOCK)])
                self.products += len(r)
            else:
                scores = products(q, self.x[lo + at])[r, np.searchsorted(at, c)]
                self.products += len(q) * len(at)
            bound[hope] = -np.inf
            good = scores >= best.floors[r]
            best.add(r[good], self.ids[lo + c[good]], scores[good])
            size *= 2


def sampled(rows: DataFrame):
    """The sample, as (ids, matrix) by length class, and the pivots."""
    sized = rows.filter(F.size("v") <= SAMPLE_COMPONENTS // 16).withColumn("h", F.xxhash64("vec_id", "v"))
    sizes = [r[0] for r in sized.select(F.size("v"), "h", "vec_id").orderBy("h", "vec_id", "size(v)").limit(SAMPLE).collect()]
    count = int(np.searchsorted(np.cumsum(sizes), SAMPLE_COMPONENTS, "right"))
    found = sized.orderBy("h", "vec_id", F.size("v")).limit(count).select("vec_id", "v").toArrow()
    ids = found.column("vec_id").to_numpy()
    groups = [(ids[at], x) for at, x in by_length(found.column("v"))] if count else []
    width = min(max((x.shape[1] for _, x in groups), default=1), 2 * SAMPLE_COMPONENTS // max(count, 1))
    points = np.zeros((count, width))
    lo = 0
    for ids, x in groups:
        points[lo : lo + len(ids), : x.shape[1]] = x[:, :width]
        lo += len(ids)
    return groups, pick_pivots(points)


def query_blocks(folder: str):
    """Blocks of the stored queries as Arrow batches, of one length class and about ``QUERY_BYTES`` each."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = filesystem(folder)
    for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
        if not info.path.endswith(".parquet"):
            continue
        kind = int(info.path.rpartition("/")[0].rpartition("kind=")[2])
        rows = min(QUERY_BLOCK, max(1, QUERY_BYTES >> (kind + 3)))
        with store.open_input_file(info.path) as source:
            yield from pq.ParquetFile(source).iter_batches(rows)


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score, query_key: exact, for queries whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = quantised(vectors)
    model = stored_object(spark, "topk-sample", sampled(rows))
    query_dir = shared_dir(spark, "topk-queries")

    def floors(batches):
        with held(model, lambda: kept_object(model)) as (groups, _):
            known = sum(len(ids) for ids, _ in groups)
            for batch in batches:
                ids, found = batch.column("vec_id").to_numpy(), np.full(batch.num_rows, -np.inf)
                for lo in range(0, batch.num_rows if known >= k else 0, QUERY_BLOCK):
                    for at, q in by_length(batch.column("v").slice(lo, QUERY_BLOCK)):
                        scores = np.concatenate([np.where(ids[lo + at, None] == i[None, :], -np.inf, products(q, x)) for i, x in groups], axis=1)
                        # repeated sample ids are distinct candidates, so the k-th largest is a floor
                        found[lo + at] = np.partition(scores, known - k, axis=1)[:, -k]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "floor"])

    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("query_key", F.xxhash64("vec_id", "v"))
    queries = asked.dropDuplicates(["vec_id", "v"]).select("query_key", "vec_id", "v", length_class(F.size("v")).alias("kind"))
    floored = queries.mapInArrow(floors, "query_key long, vec_id long, v array<double>, kind int, floor double")
    floored.write.partitionBy("kind").option("parquet.block.size", 16 << 20).parquet(query_dir)

    def work(batches):
        with held(model, lambda: kept_object(model)) as (_, pivots):
            for part in parts_of(batches, pivots):
                for block in query_blocks(query_dir):
                    keys, q_ids = block.column("query_key").to_numpy(), block.column("vec_id").to_numpy()
                    q = matrix(block.column("v"), int(pc.max(pc.list_value_length(block.column("v"))).as_py()))
                    found, ids, scores = part.search(q_ids, q, distances(q, pivots), block.column("floor").to_numpy(), k)
                    scores = np.where(scores >= 2.0**63, np.iinfo(np.int64).max, np.clip(scores, -(2.0**63), 2.0**63 - 1024).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[found]), pa.array(q_ids[found]), pa.array(ids), pa.array(scores)], names=["query_key", "query_id", "vec_id", "score"])

    found = rows.mapInArrow(work, "query_key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_key")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
