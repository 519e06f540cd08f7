"""Golden cases of the frame, layout, merge and evaluation operators."""

import random

import pytest
from pyspark.sql import functions as F

from codeframes.operators import crawl, evaluate, frames, layout, merge
from codeframes.schemas import ANNOTATIONS, Settings, parse_crop

E = "video_id string, seq bigint, path string, timestamp_ms bigint, text string, confidence double"


def extractions(spark, rows):
    return spark.createDataFrame([("v", i, p, t, x, c) for i, (p, t, x, c) in enumerate(rows)], E)


def merged(spark, rows, **kw):
    c = merge.cluster(extractions(spark, rows), kw.get("similarity", 0.85))
    return c, merge.snippets(c)


def test_runs_collapse_against_the_frame_kept_last(spark):
    def run(hashes, d):
        df = spark.createDataFrame([("v", i, h) for i, h in enumerate(hashes)], "video_id string, seq bigint, phash bigint")
        return sorted(r.seq for r in frames.collapse_runs(df, d).collect())

    a, b, c = 0, 0b11, -1
    assert run([a, b, c], 4) == [0, 2] and run([a, b, b, c, a], 4) == [0, 3, 4] and run([a, b, c], 1) == [0, 1, 2]
    assert run([0, 0b1, 0b11, 0b111], 1) == [0, 2]  # drift counts from the kept one
    with pytest.raises(ValueError):
        run([a], -1)


def test_runs_against_a_plain_model(spark):
    rng = random.Random(3)
    rows = [(f"v{v}", i, rng.getrandbits(6)) for v in range(40) for i in range(rng.randint(1, 60))]
    want, last = [], {}
    for v, i, h in rows:
        if v not in last or bin(h ^ last[v]).count("1") > 2:
            last[v] = h
            want.append((v, i))
    df = spark.createDataFrame(rows, "video_id string, seq bigint, phash bigint").repartition(7)
    assert sorted((r.video_id, r.seq) for r in frames.collapse_runs(df, 2).collect()) == sorted(want)


def test_pairs_need_equal_counts(spark):
    a, b = spark.createDataFrame([("v", 1), ("v", 2)], "video_id string, x int"), spark.createDataFrame([("v", 9)], "video_id string, y int")
    with pytest.raises(Exception, match="differ in number"):
        frames.pair_by_ordinal(a, b, ["video_id"], [F.col("x")], [F.col("y")]).collect()
    assert frames.pair_by_ordinal(a, b, ["video_id"], [F.col("x")], [F.col("y")], strict=False).count() == 2


def annotated(spark, ann, w=100, h=100):
    df = spark.createDataFrame([("v", "p", 0, w, h, ann)], ANNOTATIONS)
    return layout.extractions(df).first()


@pytest.mark.parametrize(("box", "size", "want"), [
    ([0.1, 0.8, 0.4, 0.1], (100, 100), (10, 10, 40, 10)), ([0.126, 0.8, 0.4, 0.1], (100, 100), (13, 10, 40, 10)), ([0.9, 0.0, 0.5, 0.5], (100, 100), (90, 50, 10, 50)), ([0.0, 0.0, 1.0, 1.0], (200, 120), (0, 0, 200, 120)),
])
def test_pixel_boxes(spark, box, size, want):
    b = annotated(spark, [("x", "0.5", box)], *size).bboxes[0]
    assert (b.x, b.y, b.width, b.height) == want


def test_reading_order(spark):
    at = lambda y, x=0.1, h=0.1: [x, 1 - y - h, 0.2, h]
    row = annotated(spark, [("third", "0.9", at(0.5)), ("first", "0.9", at(0.1)), ("fourth", "0.9", at(0.7)), ("second", "0.9", at(0.3))])
    assert row.text == "first\nsecond\nthird\nfourth"
    assert annotated(spark, [("# note", "1", at(0.10, 0.5)), ("x = 1", "1", at(0.11)), ("y = 2", "1", at(0.4))]).text == "x = 1 # note\ny = 2"
    assert annotated(spark, [("name", "1", at(0.10, 0.3)), ("'", "1", at(0.08, 0.1, 0.04))]).text == "' name"
    row = annotated(spark, [("a", "0.8", at(0.1)), ("bad", "0.9", [0.1]), ("bad", "high", at(0.2)), ("bad", None, at(0.2)), ("b", "1.0", at(0.5))])
    assert row.text == "a\nb" and row.confidence == pytest.approx(0.9)
    row = annotated(spark, [])
    assert (row.text, row.confidence, row.bboxes) == ("", 0.0, [])


def test_box_union(spark):
    df = spark.createDataFrame([("a", 0, 0, 10, 10), ("a", 5, 5, 10, 10), ("b", 0, 0, 2, 2), ("b", 10, 20, 5, 5)], "g string, x int, y int, width int, height int")
    assert sorted(map(tuple, layout.box_union(df, ["g"]).collect())) == [("a", 0, 0, 15, 15), ("b", 0, 0, 15, 25)]


def test_merge_goldens(spark):
    c, s = merged(spark, [("/a", 0, "return value", 0.95), ("/b", 1, "return va1ue", 0.80)])
    row = s.withColumn("notes", merge.notes()).first()
    assert (row.code, len(row.sources), row.notes) == ("return value", 2, "")
    assert merged(spark, [("/a", 0, "import os", 0.9), ("/b", 1, "class Foo: pass", 0.9)])[1].count() == 2
    assert merged(spark, [("/f/a/b", 0, "x = 10 + y", 0.9), ("/f/a", 0, "x = 10 + z", 0.9)])[1].first().code == "x = 10 + z"
    assert [r.sources[0].timestamp_ms for r in merged(spark, [("/a", 5000, "alpha beta", 0.9), ("/b", 10, "something else", 0.9)])[1].orderBy("position").collect()] == [10, 5000]
    assert merged(spark, [("/a", 0, "x = 1  \ny = 2\n", 0.9), ("/b", 1, "x = 1\ny = 2", 0.9)])[1].count() == 1
    assert merged(spark, [("/a", 0, "abcdefghij", 0.9), ("/b", 1, "abcdefghiX", 0.9)], similarity=0.99)[1].count() == 2
    assert merged(spark, [])[1].count() == 0
    with pytest.raises(ValueError):
        merge.cluster(extractions(spark, []), 1.1)


def test_merge_notes(spark):
    note = lambda rows: merged(spark, rows)[1].select(merge.notes()).first()[0]
    assert note([("/a", 0, "a = b + c", 0.88), ("/b", 1, "a = b - c", 0.86)]) == "conflict: 2 differing transcriptions with near-equal confidence (representative 0.88 vs runner-up 0.86); kept the highest-confidence one"
    assert note([("/a", 0, "a = b + c", 0.30), ("/b", 1, "a = b - c", 0.95)]) == ""
    assert note([("/a", 0, "code", 0.20)]) == "low confidence: representative confidence 0.20 < 0.50"
    assert note([("/a", 0, "a = b + c", 0.8), ("/b", 1, "a = b - c", 0.7)]) == ""  # 0.8 - 0.7 is above 0.1 in doubles


def test_clusters_against_a_plain_model(spark):
    rng = random.Random(5)
    rows = [(f"v{v}", i, "p", i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))), 0.5) for v in range(30) for i in range(12)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for t in (0.5, 0.85):
        want, seeds = [], {}
        for v, i, _, _, x, _ in rows:
            own = seeds.setdefault(v, [])
            for k, s in enumerate(own):
                if (1.0 if not x and not s else 1 - distance(x, s) / max(len(x), len(s))) >= t:
                    break
            else:
                own.append(x)
                k = len(own) - 1
            want.append((v, i, k))
        got = merge.cluster(spark.createDataFrame(rows, E), t).select("video_id", "seq", "cluster_id").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_provenance_is_by_membership(spark):
    c, s = merged(spark, [("/a", 5, "alpha beta gamma", 0.9), ("/a", 5, "quite another text", 0.9), ("/b", 1, "alpha beta gamm", 0.5)])
    got = [(r.entry, r.timestamp, r.screenshot, r.raw_ocr, r.cleaned_code) for r in merge.provenance(c, s).orderBy("entry").collect()]
    assert got == [(0, 1, "/b", "alpha beta gamm", "alpha beta gamma"), (1, 5, "/a", "alpha beta gamma", "alpha beta gamma"), (2, 5, "/a", "quite another text", "quite another text")]


def test_scripts(spark):
    df = spark.createDataFrame([("v", 1, "b = 2\n\n"), ("v", 0, "a = 1"), ("v", 2, " \n"), ("w", 0, " ")], "video_id string, position bigint, code string")
    assert {r.video_id: r.script for r in merge.scripts(df).collect()} == {"v": "a = 1\n\n\nb = 2\n", "w": ""}


def test_benchmark(spark):
    rows = [("good", "a", "x = 1", "x = 1", None), ("lossy", "a", "x = 1", "", None), ("bad", "a", "x = 1", "x = 1", "no network")]
    report = evaluate.benchmark(evaluate.score_predictions(spark.createDataFrame(rows, "backend string, name string, truth string, text string, error string")))
    order = spark.createDataFrame([("lossy", 0), ("good", 1)], "backend string, ordinal int")
    assert evaluate.winner(report, order).first().winner == "good" and report.count() == 2
    shown = evaluate.format_report(report, ["lossy", "good", "bad"])
    assert shown.splitlines()[0].split() == ["backend", "levenshtein", "token_acc", "aggregate"] and "Winner: good" in shown
    none = report.filter("false")
    assert evaluate.winner(none, order).first().winner is None and "no backends" in evaluate.format_report(none, [])


def test_links_and_streams(spark):
    html = '<a href="/lesson/2">b</a><A class="x" HREF=\'lesson/9\'>z</A><a href="/lesson/2">again</a><a href="https://o.io/lesson/1">c</a><a href="//p.io/lesson/3">d</a><a href="/about">e</a>'
    pages = spark.createDataFrame([(1, "https://x.io/c/index.html?q", html)], "page_id int, url string, html string")
    got = [r.link for r in crawl.page_links(pages, containing="lesson/").orderBy("position").collect()]
    assert got == ["https://x.io/lesson/2", "https://x.io/c/lesson/9", "https://o.io/lesson/1", "https://p.io/lesson/3"]


def test_links_resolve_as_the_standard_library_has_them(spark):
    from urllib.parse import urljoin

    from codeframes.functions import urls

    rng = random.Random(4)
    bases = ["http://a.x", "https://a.x/", "http://a.x/b/c/d;p?q", "http://a.x/b/c/", "http://a.x/b?q=/z/", "HTTP://A.x/b/../c", "http://a.x?q", "http://a.x/é//f/", ""]
    links = ["", "?p=1", "#f", "?", "#", ".", "..", "./", "../", "../../../g", "/../x", "/./x/", "//h.y", "//h.y/p/../q", "http:g", "https://o.z/..", "mailto:a@b", "g?y/../x", "g#s/../x", ";x", "x//y", "/x//y/", "  sp ace", "/lesson/1"]
    parts = ["..", ".", "", "lesson", "a b", "x;y", "é", "?q=1", "#z", "1"]
    links += ["/".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    rows = [(rng.choice(bases) if i >= 24 * len(bases) else bases[i % len(bases)], links[i // len(bases)] if i < 24 * len(bases) else links[i - 24 * len(bases) + 24]) for i in range(24 * len(bases) + 1500)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b string, l string").select("b", "l", urls.resolve(F.col("b"), F.col("l")).alias("u"))
    assert [r for r in got.collect() if r.u != urljoin(r.b, r.l)] == []


def test_anchors(spark):
    from codeframes.functions import urls

    html = """<a href=/lesson/1>x</a><!-- <a href="/lesson/2"> --><A title="a > b" HREF = '/lesson/3?a=1&amp;b=&#50;&#x33;&amp;lt;&bogus;'>y</A>
        <script>var s = '<a href="/lesson/4">';</script><a data-href="/lesson/5" name=z>no</a><a\nhref="/lesson/6"/><abbr href="/lesson/7"><a>none</a><style>a {}</style ><a href="">"""
    got = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(urls.anchors(F.col("h"))).collect()
    assert [r[0] for r in got] == [["/lesson/1", "/lesson/3?a=1&b=23&lt;&bogus;", "/lesson/6", ""], None, []]


def test_fields_of_streams(spark):
    cases = {
        "{'videoUrl' : 'http://h/1.m3u8?x'}": "http://h/1.m3u8", '{"videoUrl":"m3u8"}': None, "videoUrl: 'a.m3u8'": None, '"videoUrl"\n:\n"b.m3u8" "videoUrl":"c.m3u8"': "b.m3u8",
        '"videoUrl":"x.mp4" and "videoUrl" : "y.m3u8"': "y.m3u8", '"videoUrl" = "z.m3u8"': None,
    }
    got = spark.createDataFrame([(h,) for h in cases], "h string").select("h", crawl.stream_url(F.col("h"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_settings():
    for bad in ({"fps": 0}, {"score_threshold": 1.5}, {"escalate_below": -0.1}, {"scene_threshold": 0.0}, {"scene_threshold": 1.5}, {"dedup_max_distance": -1}, {"similarity_threshold": 1.1}, {"low_confidence_threshold": -0.5}, {"conflict_margin": 2.0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    for bad in ("1,2,3", "a,b,c,d", "0,0,0,10", "-1,0,10,10"):
        with pytest.raises(ValueError):
            parse_crop(bad)
    assert parse_crop("1,2,3,4").width == 3


def test_null_texts_and_hashes(spark):
    rows = [("v", 0, "p", 0, None, 0.5), ("v", 1, "p", 1, "", 0.5), ("v", 2, "p", 2, "x = 1", 0.5), (None, 0, "p", 0, None, 0.5)]
    got = merge.cluster(spark.createDataFrame(rows, E)).select("video_id", "seq", "cluster_id", "norm").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("v", 0, 0, ""), ("v", 1, 0, ""), ("v", 2, 1, "x = 1"), (None, 0, 0, "")], key=repr)
    hashes = [("v", 0, 5), ("v", 1, None), ("v", 2, 5), ("w", 0, None), ("w", 1, 0), ("w", 2, 0)]
    kept = frames.collapse_runs(spark.createDataFrame(hashes, "video_id string, seq bigint, phash bigint"), 0)
    assert sorted(map(tuple, kept.select("video_id", "seq").collect())) == [("v", 0), ("v", 1), ("w", 0), ("w", 1)]


def test_a_long_video_has_the_clusters_of_first_fit(spark):
    """All texts in one video, with letters beyond ASCII, against a loop over the seeds."""
    from codeframes.functions.distance import distances

    rng = random.Random(8)
    base = ["".join(rng.choice("abcdé =()\n") for _ in range(rng.randint(0, 70))).strip() for _ in range(150)]
    texts = [b.replace(rng.choice("abcdé"), "x", 2) for b in base for _ in range(4)]
    rng.shuffle(texts)
    rows = [("v", i, "p", i, t, 0.5) for i, t in enumerate(texts)]
    clustered = merge.cluster(spark.createDataFrame(rows, E)).orderBy("seq").select("norm", "cluster_id").collect()
    seeds = []
    for norm, got in clustered:
        found = distances([norm] * len(seeds), seeds).tolist()
        want = next((k for k, (d, s) in enumerate(zip(found, seeds, strict=True)) if not norm and not s or 1.0 - d / max(len(norm), len(s)) >= 0.85), len(seeds))
        if want == len(seeds):
            seeds.append(norm)
        assert got == want


def test_probes(spark):
    from codeframes.operators import crawl

    df = spark.createDataFrame([(" 12.5\n".strip(), "audio"), ("N/A", " "), (None, None)], "d string, a string")
    assert [tuple(r) for r in df.select(crawl.probe_seconds(F.col("d")), crawl.probe_has_audio(F.col("a"))).collect()] == [(12.5, True), (None, False), (None, False)]
