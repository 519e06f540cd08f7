"""Golden cases of the text functions and signals."""

import pytest
from pyspark.sql import functions as F

from codeframes.functions import scoring, text


def column(spark, values, make, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_timecode(spark):
    assert column(spark, [3725500, 0, 359999999], text.timecode, "v bigint") == ["01:02:05.500", "00:00:00.000", "99:59:59.999"]


@pytest.mark.parametrize(("a", "b", "d"), [("", "", 0), ("abc", "abc", 0), ("abc", "abd", 1), ("abc", "ab", 1), ("kitten", "sitting", 3), ("", "abc", 3), ("é", "e", 1)])
def test_similarity(spark, a, b, d):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(text.similarity("a", "b"), *(text.similar(F.col("a"), F.col("b"), t) for t in (0.0, 0.5, 0.85, 1.0))).first()
    want = 1.0 if not a and not b else 1 - d / max(len(a), len(b))
    assert row[0] == want and list(row)[1:] == [want >= t for t in (0.0, 0.5, 0.85, 1.0)]


def test_normalize_is_that_of_lines(spark):
    import random

    rng = random.Random(0)
    texts = ["".join(rng.choice("ab \t\n\r\x0b\x0c\x1c\x85 \xa0") for _ in range(rng.randint(0, 14))) for _ in range(3000)]

    def plain(t):
        lines = [x.rstrip() for x in t.splitlines()]
        while lines and not lines[0]:
            lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        return "\n".join(lines)

    assert column(spark, texts, text.normalize) == [plain(t) for t in texts]


def test_token_accuracy(spark):
    rows = [("import os", "import sys"), ("", ""), ("x", ""), ("", "x"), ("a a b", "a b b")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(text.token_accuracy("a", "b")).collect()] == [0.5, 1.0, 0.0, 0.0, 2 / 3]


FENCES = [
    ("```python\nx = 1\n```", "x = 1"), ("```\n\n    y\n```\nmore", "    y"), ("plain\n", "plain"), ("```py\nopen", "open"), ("```\na ``` b\n```", "a ``` b"), ("", ""), ("```\n```", ""), ("  kept  \n\n", "  kept  "),
]


def test_fences(spark):
    assert column(spark, [a for a, _ in FENCES], text.strip_fence) == [b for _, b in FENCES]


def test_transcript_confidence(spark):
    got = column(spark, ["ok", "a [?] b [?]", "[?]" * 20, " \n", ""], text.transcript_confidence)
    assert [round(x, 9) for x in got] == [0.9, 0.7, 0.1, 0.1, 0.1]
    df = spark.createDataFrame([("ok", "length"), ("ok", "stop"), ("ok", None)], "t string, r string")
    assert [r[0] for r in df.select(text.transcript_confidence("t", "r")).collect()] == [0.3, 0.9, 0.9]


CODE = "from pathlib import Path\n\n\ndef largest(folder, limit):\n    sizes = [p.stat().st_size for p in Path(folder).iterdir()]\n    return sorted(sizes)[-limit:]\n"
BOUNDS = [
    (CODE, 0.6, 1.01), ("let area = (w, h) => {\n  return w * h;\n};\n", 0.6, 1.01), ("", 0, 1e-9), ("\n \t\n", 0, 1e-9), ("import zlib as z", 0.3, 1.01), ("npm install left-pad", 0.3, 1.01),
    ("class Shelf {\n    int books = 3;\n}", 0.6, 1.01), ("private final void close(Stream out) {", 0.6, 1.01), ("SELECT price FROM parts WHERE size > 3", 0.3, 1.01),
    ("SELECT p.name, s.city FROM parts p JOIN shops s ON p.shop = s.id", 0.3, 1.01), ('<p lang="en">words</p>', 0.3, 1.01), ("LAST_STEP", 0.01, 0.4),
    ("select two of these plums from that tree", 0, 0.2), ("please select a chair from row nine", 0, 0.2), ("bring your ticket(s) and pass(es) along", 0, 0.2), ("class reunion: bring cake", 0, 0.2),
    ("  -> rest a little", 0, 0.4), ("While we wait for the bus, try to return what you import with every async letter.", 0, 0.2), ("n = ", 0.2, 1.01),
]


def test_scores_lie_in_their_bounds(spark):
    for (t, low, high), got in zip(BOUNDS, column(spark, [b[0] for b in BOUNDS], scoring.code_score), strict=True):
        assert low <= got < high, (t, got)


def test_a_score_at_the_threshold_passes(spark):
    from codeframes.operators.escalate import gate

    df = spark.createDataFrame([("import x",), ("plain",), ("MAX_A",)], "text string")
    assert [r.score for r in gate(df, 0.45).collect()] == [0.45] and gate(df, 0.12).count() == 2


def test_sizes_times_and_slugs(spark):
    assert column(spark, [0, 999, 1000, 1449, 1450, 949550, 1150000, 2500000000], text.size_text, "v bigint") == ["0 B", "999 B"] + [f"{n / u:.1f} {x}" for n, u, x in ((1000, 1e3, "KB"), (1449, 1e3, "KB"), (1450, 1e3, "KB"), (949550, 1e3, "KB"), (1150000, 1e6, "MB"), (2500000000, 1e9, "GB"))]
    assert column(spark, [59, 60, 3600, 7325], text.clock, "v int") == ["0:59", "1:00", "1:00:00", "2:02:05"]
    assert column(spark, [59, 7325], text.hours_minutes, "v int") == ["0m", "2h 2m"]
    assert column(spark, ["1:02:03.5", "2:3", "a:b:c"], text.hms_to_seconds) == [3723.5, None, None]
    assert column(spark, ["https://x.io/course/Intro to C++!/", "https://x.io", "/a/b?c#d", ""], lambda c: text.url_slug(c, "course")) == ["Intro-to-C", "course", "b", "course"]
    assert column(spark, ["/a/talk.v1.mp4", "", "/x/.bashrc", "/"], text.artifact_base) == ["talk.v1", "extracted", ".bashrc", "extracted"]


def test_two_digits(spark):
    import random

    rng = random.Random(2)
    values = [n / 100 for n in range(0, 201)] + [n / 1000 for n in range(0, 1001)] + [n / 8 for n in range(0, 80)] + [rng.random() for _ in range(3000)]
    assert column(spark, values, text.two_digits, "v double") == [f"{v:.2f}" for v in values]


def test_data_uri(spark):
    import base64

    data = bytes(range(256)) * 3
    df = spark.createDataFrame([("a.JPG", data), ("b", data)], "p string, c binary")
    assert [r[0] for r in df.select(text.data_uri("p", "c")).collect()] == [f"data:image/{k};base64,{base64.b64encode(data).decode()}" for k in ("jpeg", "png")]
    with pytest.raises(Exception, match="size limit"):
        df.select(text.data_uri("p", "c", most=10)).collect()
