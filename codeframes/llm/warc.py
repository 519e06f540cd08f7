"""WARC records in seekable Zstandard bundles.

A bundle is a ``.warc.zst`` file of independent Zstandard frames, each holding whole WARC records, and ends
with a seek table (a skippable frame with the compressed and plain size of every frame).  The index maps
each record to ``(bundle, frame, offset in the plain frame, length)``, so one record costs one frame read.  A record's id
is that of its place; a revisit names its response by page and payload digest, by which the index finds it.

Defined results: a null payload is empty; payloads below ``MIN_REVISIT`` bytes are always responses; of rows
that repeat both the smallest page_id and the payload, each is a response; a null page_id never is the
smallest one, and equal payloads of which no row has an id are all responses; an empty table gives no rows and no
bundle; of all columns only page_id, url and html are read; a payload of any length is one record, in a frame by itself.
Bundles get a fresh name per task attempt and only the committed index names them, so a retried task leaves
at most an orphan file that nothing reads.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeframes.llm.common import filesystem, shared_dir, written

MIN_REVISIT = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20

# Fixed values of the public seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX_SCHEMA = "page_id long, record_id string, digest string, bundle string, frame int, offset long, length long"
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long,"
    " payload binary, bundle string, frame int"
)


def record_id(bundle: str, number: int) -> str:
    """An id of the record's own: that of its place, as bundles have names of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{bundle}/{number}')}>"


def record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit that names the page and digest of the response holding it."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-ID: {refers_to}",
            f"X-Payload-Length: {len(payload)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(buffer: bytes, at: int = 0) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of a plain frame."""
    while at < len(buffer):
        end = buffer.index(b"\r\n\r\n", at)
        lines = buffer[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        body, size = end + 4, int(headers["Content-Length"])
        after = body + size + 4
        yield at, after - at, headers, buffer[body : body + size]
        at = after


class BundleWriter:
    """Appends records to one bundle; frames close at ``frame_bytes`` of plain data."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.plain = self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset within the plain frame."""
        if self.plain and self.plain + len(data) > self.frame_bytes:
            self.flush()
        where = (len(self.frames), self.plain)
        self.pending.append(data)
        self.plain += len(data)
        return where

    def flush(self) -> None:
        if self.pending:
            packed = self.compressor.compress(b"".join(self.pending))
            self.out.write(packed)
            self.frames.append((len(packed), self.plain))
            self.size += len(packed)
            self.pending, self.plain = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Random access by frame through the seek table at the end of a bundle."""

    def __init__(self, source):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable Zstandard bundle")
        entry = 12 if flags & 0x80 else 8
        source.seek(size - 9 - entry * count)
        table, at, self.frames = source.read(entry * count), 0, []
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, i * entry)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.source.seek(at)
        return self.decompressor.decompress(self.source.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        _, _, headers, block = next(parse(self.frame(frame), offset))
        return headers, block


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to; the join moves payloads only if the repeats don't fit a broadcast."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = written(
        rows.filter(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first_id"),
        "warc-firsts",
    )  # a written table has a known size, by which Spark broadcasts it or not
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(marked: DataFrame, out_dir: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write bundles below ``out_dir``; the returned index, itself a written table, names the bundles that count."""

    def work(batches):
        store, root = filesystem(out_dir)
        store.create_dir(root, recursive=True)
        writer, name, number = None, "", 0
        for batch in batches:
            found = []
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for page_id, url, payload, digest, refers in zip(*cols, strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(store.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                    number = 0
                own = record_id(name, number)
                data = record(own, page_id, url, payload, digest, refers)
                frame, offset = writer.add(data)
                found.append((page_id, own, digest, name, frame, offset, len(data)))
                number += 1
                if writer.size > bundle_bytes:
                    writer.close()
                    writer = None
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            names = ("page_id", "record_id", "digest", "bundle", "frame", "offset", "length")
            arrays = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 7, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=list(names))
        if writer is not None:
            writer.close()

    return written(marked.mapInArrow(work, INDEX_SCHEMA), "warc-index")


def decode(headers: dict[str, str], block: bytes) -> tuple:
    """The record's row; a stored payload must have the digest its header names."""
    number = lambda key: int(headers[key]) if key in headers else None
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    kind, payload, size = headers["WARC-Type"], None, number("X-Payload-Length")
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    return number("X-Page-ID"), headers.get("WARC-Target-URI"), size, digest, kind, number("X-Refers-To-Page-ID"), payload


def read_archives(spark: SparkSession, index: DataFrame, out_dir: str, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that ``index`` names, one bundle per task at a time, frame by frame."""
    names = index.select("bundle").distinct()
    schema = RECORD_SCHEMA if payloads else RECORD_SCHEMA.replace(" payload binary,", "")

    def work(batches):
        store, root = filesystem(out_dir)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = BundleReader(source)
                    for k in range(len(reader.frames)):
                        rows = [(*decode(h, b), name, k) for _, _, h, b in parse(reader.frame(k))]
                        cols = list(zip(*rows, strict=True))
                        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int32()]
                        heads = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
                        use = [i for i, h in enumerate(heads) if payloads or h != "payload"]
                        yield pa.RecordBatch.from_arrays([pa.array(cols[i], types[i]) for i in use], names=[heads[i] for i in use])

    tasks = max(1, spark.sparkContext.defaultParallelism * 4)
    return names.repartition(tasks).mapInArrow(work, schema)


def fetch(index: DataFrame, wanted: DataFrame, out_dir: str) -> DataFrame:
    """Records whose ``record_id`` is in ``wanted``, by frame-relative offset: reads only the frames that hold them, each once."""
    hits = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary())])

    def work(batches):
        store, root = filesystem(out_dir)
        bundle, source, reader, frame, plain = None, None, None, None, b""
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != bundle:
                    if source is not None:
                        source.close()
                    bundle, frame = row["bundle"], None
                    source = store.open_input_file(f"{root}/{bundle}")
                    reader = BundleReader(source)
                if row["frame"] != frame:
                    frame, plain = row["frame"], reader.frame(row["frame"])
                _, _, headers, block = next(parse(plain, row["offset"]))
                out = decode(headers, block)
                yield pa.RecordBatch.from_pylist([{"record_id": row["record_id"], "page_id": out[0], "payload": out[6]}], schema=schema)
        if source is not None:
            source.close()

    return hits.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(work, "record_id string, page_id long, payload binary")


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive ``pages`` and read the archives back: one row per page with what its record says."""
    out_dir = shared_dir(spark, "warc")
    index = write_archives(mark_revisits(pages), out_dir)
    return read_archives(spark, index, out_dir, payloads=False)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to
FROM f
"""
