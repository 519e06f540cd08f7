import hashlib
import io

import pytest

from codeframes.llm import warc
from codeframes.llm.common import shared_dir

PAGES = "page_id long, url string, html string, digest string"


def rows():
    big, other = "<p>" + "é" * 80 + "</p>", "y" * 99
    return [(5, "http://a/", big, "x"), (2, None, big, None), (9, "http://b/\r\nX: 1", big, None), (3, "u", other, None), (4, "u", other, None),
            (7, "u", None, None), (8, "u", "", None), (1, "u", "z" * 600_000, None), (2, None, big, None), (6, "u", "z" * 100, None), (10, "u", "z" * 100, None)]


def test_archive_gives_each_page_its_record(spark):
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(spark, spark.createDataFrame(rows(), PAGES)).collect())
    first = {}
    for i, _, html, _ in rows():
        b = (html or "").encode()
        if len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    want = []
    for i, _, html, _ in rows():
        b = (html or "").encode()
        f = first.get(b, i)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if f == i else "revisit", None if f == i else f))
    assert got == sorted(want)


def test_index_leads_to_single_records(spark):
    out = shared_dir(spark, "warc-test")
    index = warc.write_archives(warc.mark_revisits(spark.createDataFrame(rows(), PAGES)), out, frame_bytes=500, bundle_bytes=2000)
    assert index.select("bundle").distinct().count() >= 1
    wanted = index.filter("page_id in (1, 6, 7)").select("record_id")
    got = {r.page_id: bytes(r.payload) for r in warc.fetch(index, wanted, out).collect()}
    assert got == {1: b"z" * 600_000, 6: b"z" * 100, 7: b""}


def test_every_record_has_an_id_of_its_own(spark):
    out = shared_dir(spark, "warc-test")
    pages = spark.createDataFrame([*rows(), (None, "u", "z" * 100, None), (None, None, None, None), (None, "u", "own " * 50, None)], PAGES)
    index = warc.write_archives(warc.mark_revisits(pages), out, frame_bytes=500, bundle_bytes=2000)
    assert index.count() == index.select("record_id").distinct().count() == pages.count()
    got = warc.fetch(index, index, out).collect()
    assert len(got) == pages.count() and {r.record_id for r in got} == {r.record_id for r in index.collect()}
    revisits = [r for r in warc.read_archives(spark, index, out).collect() if r.record_type == "revisit"]
    assert revisits and all(index.filter((index.page_id == r.refers_to) & (index.digest == r.payload_digest)).count() for r in revisits)


def test_no_pages(spark):
    assert warc.archive(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_bundle_is_plain_zstandard_and_rejects_other_files():
    import pyarrow as pa
    import zstandard

    out = io.BytesIO()
    out.close, close = (lambda: None), out.close
    writer = warc.BundleWriter(out, frame_bytes=10)
    places = [writer.add(x) for x in (b"aaaaaa", b"bbbbbb", b"c")]
    writer.close()
    assert places == [(0, 0), (1, 0), (1, 6)]
    data = out.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"aaaaaabbbbbbc"
    reader = warc.BundleReader(pa.BufferReader(data))
    assert [reader.frame(k) for k in range(2)] == [b"aaaaaa", b"bbbbbbc"]
    with pytest.raises(ValueError):
        warc.BundleReader(pa.BufferReader(b"0" * 40))
    close()
