"""Shared helpers: the folder all executors see, written tables, and table reading."""

from __future__ import annotations

import pickle
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in tests.
FALLBACK_SHARED = "/tmp/checkpoints"

#: Word characters of the contracts: anything but these ASCII white-space characters.
ASCII_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share.

    Without that setting a local master gets ``FALLBACK_SHARED``; on a cluster its lack is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = FALLBACK_SHARED
    return f"{base.rstrip('/')}/codeframes/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """pyarrow's file system of a path below the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def drop(*paths: str) -> None:
    """Delete tables of the shared folder that nothing rests on any more; what can't be deleted stays."""
    for path in paths:
        try:
            store, root = filesystem(path)
            store.delete_dir(root)
        except OSError:
            pass


def stored_object(spark: SparkSession, name: str, value) -> str:
    """Write a small object, such as a trained model, to the shared folder, where tasks read it with ``kept_object``.

    Unlike a broadcast it takes no memory of driver and executors, and a worker lets go of it when idle."""
    path = f"{shared_dir(spark, name)}.pickle"
    store, root = filesystem(path)
    store.create_dir(root.rpartition("/")[0], recursive=True)
    with store.open_output_stream(root) as out:
        out.write(pickle.dumps(value))
    return path


def kept_object(path: str):
    store, root = filesystem(path)
    with store.open_input_stream(root) as source:
        return pickle.loads(source.read())


def written_at(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """``df`` as a table of the shared folder, and its path: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    return written_at(df, name, codec)[0]


def join_heads(members: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """``members`` with the columns of ``heads``, which has one row a key and the number of its members as ``n``.

    A key with over an eighth of an even share of all members is dealt over several tasks: its members by their place in
    the input, and a copy of its head to each.  So at most ``8 * p`` keys are listed (p: shuffle partitions), and at most
    ``16 * p`` heads copied.  Both inputs must be read from tables, so that a task that runs again deals alike."""
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = heads.agg(F.sum("n")).first()[0] or 0
    most = max(64, total // (8 * parts))
    salts = F.ceil(F.col("n") / most).cast("int")
    hot = heads.filter(F.col("n") > most).select(key, salts.alias("__salts"))
    listed = hot.collect()
    if not listed:
        return members.join(heads.drop("n"), key)
    own = F.pmod(F.monotonically_increasing_id(), F.col("__salts")).cast("int")
    dealt = members.join(F.broadcast(spark.createDataFrame(listed, hot.schema)), key, "left").withColumn("__salt", F.coalesce(own, F.lit(0)))
    copied = heads.withColumn("__salt", F.explode(F.when(F.col("n") > most, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied.drop("n"), [key, "__salt"]).drop("__salt", "__salts")


#: Whole texts are long: Arrow batches to Python workers are held to this many bytes.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES``, for operators that send whole texts to Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


#: Seconds after the last task that used it until a Python worker lets go of what it keeps between tasks.
IDLE_SECONDS = 2.0
_HELD: dict = {}
_LOCK = threading.Lock()


def release() -> None:
    """Let go of what this process keeps between tasks, and give freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    with _LOCK:
        _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@contextmanager
def held(key, make: Callable) -> Iterator:
    """What ``make`` gives, one object per Python worker, kept from task to task while they follow each other closely.

    A worker holds one key at a time, and nothing once it has been idle for ``IDLE_SECONDS``: caches and models
    of a stage don't stay in memory beside those of the next."""
    with _LOCK:
        timer = _HELD.pop("timer", None)
        if _HELD.get("key") != key:
            _HELD.clear()
    if timer:
        timer.cancel()
    if "value" not in _HELD:
        value = make()
        with _LOCK:
            _HELD.update(key=key, value=value)
    value = _HELD["value"]
    try:
        yield value
    finally:
        timer = threading.Timer(IDLE_SECONDS, release)
        timer.daemon = True
        with _LOCK:
            if _HELD.get("key") == key:
                _HELD["timer"] = timer
        timer.start()


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for rows whose crc32 of the id as text is divisible by 5; these are never learned from."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_slices(texts, rows: int = 256, size: int = 2 << 20):
    """Lists of a pandas series' texts, of at most ``rows`` rows and about ``size`` characters, one row at least."""
    part, total = [], 0
    for t in texts:
        if part and (len(part) >= rows or total + len(t or "") > size):
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t or "")
    if part:
        yield part


def slices(batch, column: str = "text", rows: int = 512, size: int = 4 << 20):
    """Parts of an Arrow batch of at most ``rows`` rows and about ``size`` bytes of ``column``, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    total, start = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(total, total[start] + size, "right")) - 1
        stop = max(start + 1, min(stop, start + rows, batch.num_rows))
        yield batch.slice(start, stop - start)
        start = stop
